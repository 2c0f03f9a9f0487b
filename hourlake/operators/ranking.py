"""First / newest rows per key, top-k and dedupe.

All of them rank with `row_number() <= n`, which Spark also applies before the
shuffle (WindowGroupLimit), so a key holding a third of all rows sends at most
n rows per map task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.session import cut_lineage

GROUP_LIMIT = 1000  # ranks Spark prunes ahead of the shuffle
SALTS = 64


def keep_first(df: DataFrame, keys: list, order: list[Column], n: int = 1) -> DataFrame:
    """First n rows per key in the given total order."""
    if n >= GROUP_LIMIT:
        # too deep for the map-side limit: first rank inside spread-out parts of a key
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        df = _ranked(df, [*keys, "_salt"], order, n).drop("_salt")
    return _ranked(df, keys, order, n)


def _ranked(df: DataFrame, keys: list, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def newest(*cols: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def oldest(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def dedupe(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row per key; the order decides which."""
    return keep_first(df, keys, order)


def latest_per(df: DataFrame, keys: list, ts: str, ties: list[str]) -> DataFrame:
    """Newest row per key, ties by the highest tie-breakers."""
    return keep_first(df, keys, newest(ts, *ties))


def recent_n(df: DataFrame, keys: list, ts: str, n: int, ties: list[str] = ()) -> DataFrame:
    return keep_first(df, keys, newest(ts, *ties), n)


def latest_batch(df: DataFrame, keys: list, ts: str) -> DataFrame:
    """All rows of the newest batch per key, from a pre-aggregated maximum."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    return df.join(last, keys).where(F.col(ts) == F.col("_last")).drop("_last").select(df.columns)


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank_order") -> DataFrame:
    """with_rank for a few keys with very many rows: no task holds a whole key.

    Rows are range-partitioned in the order of the result and stored; a row's rank is its rank
    within its part plus the rows of its key in the parts before, of which there is one count each.
    """
    parts = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    ranked = parts.withColumn("_rn", F.row_number().over(inside)).join(counts, [*same, F.col("_part") == F.col("_p")])
    return ranked.select(*df.columns, (F.col("_before") + F.col("_rn")).cast("int").alias(name))


def with_rank(df: DataFrame, keys: list, order: list[Column], name: str = "rank_order") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
