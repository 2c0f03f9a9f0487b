"""Lag, rolling and target features over hourly series.

A series holds at most one row per hour (deduped before), so its window is
bounded by the time span, never by the volume of raw readings. All windows of
one frame key share one shuffle and one sort.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.functions import when
from hourlake.operators import matching
from hourlake.operators.ranking import dedupe, newest

SERIES = ["location_id", "device_id"]
LAGS = (1, 6, 12, 24)
ROLLING = (24, 168)
SHORT = {"temperature": "temp", "humidity": "humidity"}


def series_window(keys=SERIES, ts="hour_ts"):
    return Window.partitionBy(*keys).orderBy(ts)


def prefer(joined: DataFrame) -> DataFrame:
    """Sensor value, else reference value; rows still missing one are dropped."""
    return joined.select(
        "location_id",
        "province_id",
        "device_id",
        "hour_ts",
        F.coalesce("esp32_temperature_avg", "meteostat_temperature").alias("temperature"),
        F.coalesce("esp32_humidity_avg", "meteostat_humidity").alias("humidity"),
        "meteostat_temperature",
        "meteostat_humidity",
    ).where(
        F.col("hour_ts").isNotNull() & F.col("temperature").isNotNull() & F.col("humidity").isNotNull()
    )


def one_per_hour(df: DataFrame) -> DataFrame:
    rest = [c for c in ("temperature", "humidity", "meteostat_temperature", "meteostat_humidity", "province_id")
            if c in df.columns]
    return dedupe(df, [*SERIES, "hour_ts"], newest(*rest))


def lag_columns(cols, steps=LAGS, w=None) -> dict[str, Column]:
    w = w or series_window()
    return {f"{SHORT.get(c, c)}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in steps}


def rolling_columns(cols, sizes=ROLLING, fn: str = "avg", w=None) -> dict[str, Column]:
    """Over the last n rows including the current one; short frames allowed."""
    w = w or series_window()
    f = {"avg": F.avg, "min": F.min, "max": F.max}[fn]
    tag = "" if fn == "avg" else f"{fn}_"
    return {
        f"{SHORT.get(c, c)}_rolling_{tag}{n}": f(c).over(w.rowsBetween(-(n - 1), 0)) for c in cols for n in sizes
    }


def target_columns(cols, horizons=(168,), w=None) -> dict[str, Column]:
    w = w or series_window()
    return {f"{SHORT.get(c, c)}_target_{h}": F.lead(c, h).over(w) for c in cols for h in horizons}


def add_lags(df, cols, steps=LAGS, w=None):
    return df.withColumns(lag_columns(cols, steps, w))


def add_rolling(df, cols, sizes=ROLLING, fn="avg", w=None):
    return df.withColumns(rolling_columns(cols, sizes, fn, w))


def add_targets(df, cols, horizons=(168,), w=None):
    return df.withColumns(target_columns(cols, horizons, w))


def build_features(joined: DataFrame, horizons=(168,), cyclic: bool = False, spine: bool = False) -> DataFrame:
    """The training table. `spine` puts every hour in place first, so that row offsets are hours."""
    base = one_per_hour(prefer(joined))
    if spine:
        base = hour_spine(base)
    cols = ["temperature", "humidity"]
    out = base.select(
        "*",
        *when.calendar("hour_ts"),
        *[
            c.alias(n)
            for n, c in {
                **lag_columns(cols),
                **rolling_columns(cols),
                **target_columns(cols, horizons),
            }.items()
        ],
    )
    if cyclic:
        out = out.select(
            "*",
            *when.cyclic("hour", 24),
            *when.cyclic("month", 12),
            *when.cyclic("day_of_week", 7),
        )
    return out


def hour_spine(base: DataFrame) -> DataFrame:
    """Every hour between the first and last of each series; missing hours have NULL values."""
    span = base.groupBy(*SERIES).agg(
        F.min("hour_ts").alias("_a"), F.max("hour_ts").alias("_b"), F.min("province_id").alias("_p")
    )
    hours = span.select(
        *SERIES, "_p", F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR"))).alias("hour_ts")
    )
    keys = [*SERIES, "hour_ts"]
    on = reduce(lambda x, y: x & y, [F.col(f"h.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rest = [c for c in base.columns if c not in (*keys, "province_id")]
    return hours.alias("h").join(base.alias("b"), on, "left").select(
        *[F.col(f"h.{k}") for k in keys],
        F.coalesce("b.province_id", "h._p").alias("province_id"),
        *[F.col(f"b.{c}") for c in rest],
    )


INPUTS = ("temperature", "humidity", "meteostat_temperature", "meteostat_humidity")


def numbered_rows(df: DataFrame, target: str, w: int, cols=INPUTS, stride: int = 1, cap: int | None = None) -> DataFrame:
    """Rows of finite inputs with their number `k` in the series, inputs `x`, `label` and `is_label`.

    A label has w rows before it, every stride-th counts; `cap` leaves the newest of each series.
    """
    vals = [F.col(c).cast("double") for c in cols]
    ok = F.lit(True)
    for v in vals:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    y, k = F.col(target).cast("double"), F.col("k")
    is_label = (k >= w) & (F.pmod(k - w, F.lit(stride)) == 0) & y.isNotNull() & ~F.isnan(y)
    rows = df.where(ok).withColumn("k", F.row_number().over(series_window()) - 1).select(
        *SERIES, "hour_ts", "k", F.array(*[v.cast("float") for v in vals]).alias("x"), y.alias("label"), is_label.alias("is_label"))
    if cap:
        newest_first = Window.partitionBy(*SERIES).orderBy(F.desc("k"))
        later = F.sum(F.col("is_label").cast("int")).over(newest_first)
        rows = rows.withColumn("is_label", F.col("is_label") & (later <= cap))
    return rows


def sequence_chunks(df: DataFrame, target: str, w: int, stride: int = 1, cap: int | None = None, cols=INPUTS, chunk: int = 1024) -> DataFrame:
    """Pieces of series: `rows` (inputs in time order) and `windows` (offset, hour_ts, label).

    A window is rows[offset : offset + w]. A piece holds the rows of `chunk` labels and a halo
    of the w rows before them, so every row is stored 1 + w / chunk times in the mean instead
    of once for each of its w windows.
    """
    size = max(chunk, w)
    rows = numbered_rows(df, target, w, cols, stride, cap)
    own = F.floor(F.col("k") / size).cast("int")
    # the last w rows of a piece are also the halo of the next one
    tail = F.pmod(F.col("k"), F.lit(size)) >= size - w
    dealt = rows.withColumn("chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    mine = F.col("is_label") & (own == F.col("chunk"))
    pieces = dealt.groupBy(*SERIES, "chunk").agg(
        F.min("k").alias("_first"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_rows"),
        F.sort_array(F.collect_list(F.when(mine, F.struct("k", "hour_ts", "label")))).alias("_labels"),
    ).where(F.size("_labels") > 0)
    window = lambda v: F.struct((v["k"] - w - F.col("_first")).alias("offset"), v["hour_ts"].alias("hour_ts"), v["label"].alias("label"))
    return pieces.select(*SERIES, "chunk", F.transform("_rows", lambda v: v["x"]).alias("rows"), F.transform("_labels", window).alias("windows"))


def sequence_windows(df: DataFrame, target: str, w: int, stride: int = 1, cap: int | None = None, cols=INPUTS, chunk: int = 1024) -> DataFrame:
    """One row per label: the w rows before it, all values finite; cut from chunks where it is read."""
    pieces = sequence_chunks(df, target, w, stride, cap, cols, chunk)
    each = pieces.select(*SERIES, "rows", F.explode("windows").alias("v"))
    return each.select(*SERIES, "v.hour_ts", F.slice("rows", F.col("v.offset") + 1, F.lit(w)).alias("sequence"), "v.label")


def bridge(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Copy the last actual before the first forecast into the forecast columns, per key.

    Two small aggregates find the row, so no series is pulled into one task.
    """
    fc = F.col("forecast_temperature").isNotNull() | F.col("forecast_humidity").isNotNull()
    act = F.col("temperature").isNotNull() | F.col("humidity").isNotNull()
    first = df.where(fc).groupBy(*keys).agg(F.min(ts).alias("_first"))
    marked = df.join(first, keys, "left")
    last = (
        marked.where(act & (F.col(ts) < F.col("_first"))).groupBy(*keys).agg(F.max(ts).alias("_last"))
    )
    return _copied(df.join(last, keys, "left"), ts)


def bridge_beside(actual: DataFrame, forecast: DataFrame, keys: list[str], ts: str, members: DataFrame, by: str) -> DataFrame:
    """`bridge` over actual rows beside the forecasts of the `by` values that their keys follow.

    The last actual is marked before the forecasts are laid beside, so forecasts go from series to
    keys in the last step and are neither shuffled nor sorted per key.
    """
    followers, series = matching.shared_series(members, forecast, keys, by)
    fc = F.col("forecast_temperature").isNotNull() | F.col("forecast_humidity").isNotNull()
    act = F.col("temperature").isNotNull() | F.col("humidity").isNotNull()
    first = series.where(fc).groupBy(matching.SHARED).agg(F.min(ts).alias("_first"))
    last = actual.where(act).select(*keys, ts).join(followers, keys).join(first, matching.SHARED)
    last = last.where(F.col(ts) < F.col("_first")).groupBy(*keys).agg(F.max(ts).alias("_last"))
    return _copied(matching.beside(actual.join(last, keys, "left"), followers, series, keys, ts), ts)


def _copied(df: DataFrame, ts: str) -> DataFrame:
    hit = F.col(ts) == F.col("_last")
    for m in ("temperature", "humidity"):
        f = f"forecast_{m}"
        use = hit & F.col(m).isNotNull() & F.col(f).isNull()
        df = df.withColumn(f"{f}_bridge", F.coalesce(use, F.lit(False))).withColumn(
            f, F.when(use, F.col(m)).otherwise(F.col(f))
        )
    return df.drop("_last")
