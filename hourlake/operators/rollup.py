"""Hourly rollups, coverage, summaries - all with map-side partial aggregation."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import measure, when
from hourlake.operators import matching

KEYS = ["device_id", "location_id", "province_id"]


def _stats(expected: int) -> list[Column]:
    n = F.count(F.lit(1))
    out = [f(m).alias(f"{m}_{k}") for m in ("temperature", "humidity") for k, f in
           (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return [*out, n.cast("int").alias("record_count"), measure.missing_ratio(n, expected).alias("missing_ratio")]


def hourly_rollup(silver: DataFrame, expected: int = measure.EXPECTED_PER_HOUR) -> DataFrame:
    """Valid readings per device, place and hour."""
    hours = silver.where(F.col("quality_flag") == "valid").withColumn("hour_ts", when.hour_floor("event_ts"))
    return hours.groupBy(*KEYS, "hour_ts").agg(*_stats(expected))


def hourly_rollup_stream(silver: DataFrame, delay: str, expected: int = measure.EXPECTED_PER_HOUR) -> DataFrame:
    """The same on a stream: an hour is emitted once the watermark has passed it."""
    valid = silver.where(F.col("quality_flag") == "valid").withWatermark("event_ts", delay)
    grouped = valid.groupBy(*KEYS, F.window("event_ts", "1 hour").alias("w")).agg(*_stats(expected))
    return grouped.withColumn("hour_ts", F.col("w.start")).drop("w")


def source_profile(df: DataFrame, type_col: str, value: str, ts: str = "event_ts") -> DataFrame:
    """Rows, first and last time per source type, over rows that have a value."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(type_col)
        .agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    )


def metric_summary(df: DataFrame, minutes: int, as_of: Column, metrics=tuple(measure.METRIC_UNITS)) -> DataFrame:
    """One row: average and total per metric over the last minutes, in one scan."""
    recent = df.where(
        (F.col("event_ts") >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("event_ts") <= as_of)
    )
    cols = []
    for m in metrics:
        v = F.when(F.col("metric_type") == m, F.col("metric_value"))
        cols += [F.avg(v).alias(f"{m}_avg"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{m}_total")]
    return recent.agg(*cols)


def count_by(df: DataFrame, keys: list[str], name: str = "row_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def coverage(obs: DataFrame, places: DataFrame, years: list[int], min_coverage: float, expected: int | None = None):
    """Per place and year: hours seen, expected hours, ratio and status. Places without rows stay."""
    spine = places.select("location_id").distinct().withColumn(
        "year", F.explode(F.array(*[F.lit(int(y)) for y in years]))
    )
    seen = obs.groupBy("location_id", F.year("event_ts").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    e = F.lit(int(expected)) if expected else when.expected_hours(F.col("year"))
    ratio = measure.coverage_ratio(F.col("row_count"), F.col("expected_hours"))
    return (
        spine.join(seen, ["location_id", "year"], "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("expected_hours", e)
        .withColumn("coverage_ratio", ratio)
        .withColumn("status", measure.coverage_status(F.col("row_count"), F.col("coverage_ratio"), min_coverage))
    )


def minute_last(df: DataFrame, keys: list[str], metrics=("temperature", "humidity"), tie: str = "id") -> DataFrame:
    """Per minute the last non-NULL value of each metric in time order."""
    pos = F.struct("event_ts", tie)
    return df.groupBy(*keys, when.minute_key("event_ts").alias("minute_ts")).agg(
        *[F.max_by(m, F.when(F.col(m).isNotNull(), pos)).alias(m) for m in metrics]
    )


def value_stats(df: DataFrame, keys: list, value: str) -> DataFrame:
    """min/avg/max over finite values."""
    v = measure.finite(F.col(value))
    return df.groupBy(*keys).agg(
        F.min(v).alias("min_value"), F.avg(v).alias("avg_value"), F.max(v).alias("max_value")
    )


def to_long(df: DataFrame, metrics: dict[str, str], ids: list[str]) -> DataFrame:
    """Wide readings -> one row per metric that has a value, with its unit."""
    unit = F.lit(None).cast("string")
    for m, u in metrics.items():
        unit = F.when(F.col("metric_type") == m, F.col(u) if u in df.columns else F.lit(u)).otherwise(unit)
    units = [u for u in metrics.values() if u in df.columns and u not in ids]
    long = df.unpivot([*ids, *units], list(metrics), "metric_type", "metric_value")
    return long.where(F.col("metric_value").isNotNull()).withColumn("unit", unit).drop(*units)


def to_wide(df: DataFrame, keys: list[str], grain: str = "hour", metrics=("temperature", "humidity")) -> DataFrame:
    """Long metrics -> one row per key and time bucket (averages)."""
    bucket = F.date_trunc(grain, when.as_ts("event_ts")).alias("bucket_ts")
    return df.groupBy(*keys, bucket).agg(
        *[F.avg(F.when(F.col("metric_type") == m, F.col("metric_value"))).alias(m) for m in metrics]
    )


def chart_rollup(actual: DataFrame, forecast: DataFrame, keys: list[str], grain: str,
                 first_day: str, last_day: str, shift_hours: int = 7, members: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Actual and forecast averages side by side per local hour or day.

    Days of the range without data are present for every key seen; hours are not filled. With
    `members` (keys, `by`) the forecasts are those of the `by` values that a key follows: they are
    averaged once for all keys that follow the same ones.
    """
    lo, hi = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")

    def inside(df, ts):
        shift = F.expr(f"INTERVAL {int(shift_hours)} HOURS")
        # bounds on the plain column, so that the scan can skip other days
        at = F.col(ts) if df.schema[ts].dataType.simpleString().startswith("timestamp") else when.as_ts(ts)
        after, until = lo.cast("timestamp") - shift, F.date_add(hi, 1).cast("timestamp") - shift
        return df.where((at >= after) & (at < until)).withColumn("_local", at + shift)

    def side(rows, keys, names):
        return rows.groupBy(*keys, F.date_trunc(grain, "_local").alias("bucket_ts")).agg(
            *[F.avg(c).alias(n) for c, n in names.items()]
        )

    names = {"temperature": "forecast_temperature", "humidity": "forecast_humidity"}
    a = side(inside(actual, "event_ts"), keys, {m: m for m in names})
    days = F.explode(F.sequence(lo.cast("timestamp"), hi.cast("timestamp"), F.expr("INTERVAL 1 DAY"))).alias("bucket_ts")
    if members is not None:
        followers, series = matching.shared_series(members, inside(forecast, "forecast_ts"), keys, by)
        f = side(series, [matching.SHARED], names)
        if grain == "day":
            a, followers, f = _with_all_days(a, followers, f, keys, days)
        return matching.beside(a, followers, f, keys, "bucket_ts")
    f = side(inside(forecast, "forecast_ts"), keys, names)
    both = a.join(f, [*keys, "bucket_ts"], "full_outer")
    if grain != "day":
        return both
    return both.select(*keys).distinct().select(*keys, days).join(both, [*keys, "bucket_ts"], "left")


def _with_all_days(a: DataFrame, followers: DataFrame, f: DataFrame, keys: list[str], days: Column):
    """The sides of a chart such that every key seen follows a series with all days.

    Keys with actual rows only, or with a NULL, follow the empty series, whose days have no values.
    """
    named = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    nothing = matching.shared_by(keys, F.array().cast(followers.schema[matching.SHARED].dataType["of"].dataType))
    seen = followers.join(f.select(matching.SHARED).distinct(), matching.SHARED, "left_semi").select(*keys, matching.SHARED)
    known = seen.union(a.select(*keys).distinct().select(*keys, nothing)).groupBy(*keys).agg(F.max(matching.SHARED).alias(matching.SHARED))
    known = known.withColumn(matching.SHARED, F.when(named, F.col(matching.SHARED)).otherwise(nothing))
    spine = known.select(matching.SHARED).distinct().select(matching.SHARED, days)
    return a.where(named), known, spine.join(f, [matching.SHARED, "bucket_ts"], "left")
