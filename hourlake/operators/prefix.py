"""Running values over long series without one task per series.

A series is cut into chunks of time. Each chunk is summarised (map-side
aggregation), the summaries - one row per chunk - are scanned in order, and each
chunk is then finished on its own with the carried-in value. The result equals
the plain window over the whole series.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 86_400


def with_chunk(df: DataFrame, ts: str, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Chunk number along a timestamp, or along a plain number."""
    c = F.col(ts)
    if dict(df.dtypes)[ts].startswith("timestamp"):
        c = F.unix_seconds(c.cast("timestamp"))
    return df.withColumn("_chunk", F.floor(c / F.lit(float(seconds))))


def _carry(df: DataFrame, keys: list[str], summary: dict[str, Column], fold: dict[str, Column]) -> DataFrame:
    """Join to every row the fold of the summaries of all earlier chunks of its key."""
    parts = df.groupBy(*keys, "_chunk").agg(*[c.alias(k) for k, c in summary.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_chunk", *[c.over(before).alias(k) for k, c in fold.items()])
    on = reduce(
        lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_chunk"]]
    )
    return df.alias("r").join(carried.alias("c"), on, "left").select("r.*", *[F.col(f"c.{k}") for k in fold])


def running_max_before(df, keys, order: list[Column], ts: str, value: str, out: str, seconds=CHUNK_SECONDS):
    """Largest value among the earlier rows of the key (NULL for none)."""
    x = _carry(
        with_chunk(df, ts, seconds), keys, {"_m": F.max(value)}, {"_carried": F.max("_m")}
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # greatest skips NULLs
    return x.withColumn(out, F.greatest("_carried", F.max(value).over(inside))).drop("_chunk", "_carried")


def last_known(df, keys, order: list[str], ts: str, values: dict[str, Column], seconds=CHUNK_SECONDS):
    """Last non-NULL of each expression up to and including the row."""
    x = with_chunk(df, ts, seconds)
    position = F.struct(*order)
    x = x.withColumns({f"_v_{k}": c for k, c in values.items()})
    x = _carry(
        x,
        keys,
        {f"_s_{k}": F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), position)) for k in values},
        {f"_c_{k}": F.last(f"_s_{k}", ignorenulls=True) for k in values},
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = {
        k: F.coalesce(F.last(f"_v_{k}", ignorenulls=True).over(inside), F.col(f"_c_{k}")) for k in values
    }
    drop = ["_chunk"] + [f"_{p}_{k}" for k in values for p in "vc"]
    return x.withColumns(out).drop(*drop)


def previous_value(df, keys, order: list[str], ts: str, value: str, out: str, seconds=CHUNK_SECONDS):
    """Value of the row just before (lag 1), across chunk borders."""
    x = with_chunk(df, ts, seconds)
    x = _carry(
        x,
        keys,
        {"_s": F.max_by(F.struct(value), F.struct(*order))},
        {"_c": F.last("_s")},
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    first = F.row_number().over(inside) == 1
    return x.withColumn(
        out, F.when(first, F.col(f"_c.{value}")).otherwise(F.lag(value).over(inside))
    ).drop("_chunk", "_c")
