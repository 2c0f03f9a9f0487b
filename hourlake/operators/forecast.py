"""Fallback forecasts, calibration, and forecast tables for all entities at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions.measure import finite
from hourlake.operators.ranking import keep_first, latest_batch

METRICS = ("temperature", "humidity")
SEASON, TREND, MINIMUM = 168, 72, 24


def forecast_grid(entities: DataFrame, horizon: int, as_of: Column, metrics=METRICS) -> DataFrame:
    """Entity x metric x step 1..H with its hour, generated in place."""
    return (
        entities.withColumn("metric_type", F.explode(F.array(*[F.lit(m) for m in metrics])))
        .withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
        .withColumn(
            "forecast_timestamp",
            F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", as_of)) + F.col("horizon_step") * 3600),
        )
    )


def recent_bias(joined: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Mean (sensor - reference) and its count per device, place and metric over the window."""
    diff = lambda m: F.col(f"esp32_{m}_avg") - F.col(f"meteostat_{m}")
    recent = joined.where(
        F.col("device_id").isNotNull() & (F.col("hour_ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    )
    long = recent.select("device_id", "location_id", *[diff(m).alias(m) for m in METRICS]).unpivot(
        ["device_id", "location_id"], list(METRICS), "metric_type", "_d"
    )
    return (
        long.where(F.col("_d").isNotNull())
        .groupBy("device_id", "location_id", "metric_type")
        .agg(F.avg("_d").alias("bias_value"), F.count(F.lit(1)).cast("int").alias("sample_count"))
    )


def tails(history: DataFrame, keys: list[str], n: int = SEASON, ts: str = "hour_ts", metrics=METRICS) -> DataFrame:
    """(keys, metric_type, values): the newest n non-NULL values, oldest first.

    At most n values per group are ever kept; the rank is pruned before the shuffle.
    """
    long = history.select(*keys, ts, *metrics).unpivot([*keys, ts], list(metrics), "metric_type", "_v")
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by = [*keys, "metric_type"]
    tail = keep_first(long, by, [F.col(ts).desc(), F.col("_v").desc()], n).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(ts, "_v"))).alias("_t")
    )
    return tail.select(*by, F.transform("_t", lambda x: x["_v"]).alias("values"))


def _line(values: Column) -> tuple[Column, Column]:
    """Least-squares (slope, intercept) over positions 0..n-1 of an array."""
    n = F.size(values).cast("double")
    fold = lambda f: F.aggregate(
        F.transform(values, lambda y, i: f(y, i.cast("double"))), F.lit(0.0), lambda a, x: a + x
    )
    sx = n * (n - 1.0) / 2.0
    sxx = (n - 1.0) * n * (2.0 * n - 1.0) / 6.0
    sy, sxy = fold(lambda y, i: y), fold(lambda y, i: y * i)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)  # NULL for a single value
    return slope, F.try_divide(sy - slope * sx, n)


def fallback_forecast(history: DataFrame, keys: list[str], horizon: int, metrics=METRICS) -> DataFrame:
    """(keys, metric_type, horizon_step, base_forecast_value, model_status) by history length.

    Under 24 values the last value repeats, from 168 on the last 168 repeat, in
    between a line through the last 72 is extended. A series without any value of a
    metric gets NULLs and `insufficient_data`. Each series is one row with a bounded
    array, so any number of series is one narrow stage after the tails.
    """
    every = history.select(*keys).distinct().withColumn("metric_type", F.explode(F.array(*[F.lit(m) for m in metrics])))
    by = [*keys, "metric_type"]
    some = tails(history, keys, SEASON, metrics=metrics).select(*[F.col(c).alias(f"_t_{c}") for c in by], "values")
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    t = every.join(some, same, "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    last = F.try_element_at("values", F.lit(-1))
    recent = F.slice("values", F.greatest(F.lit(1), F.size("values") - (TREND - 1)), F.lit(TREND))
    t = t.withColumn("_recent", recent)
    slope, intercept = _line(F.col("_recent"))
    t = t.withColumns({"_k": slope, "_b": intercept, "_n": F.size("_recent")})
    steps = t.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    seasonal = F.try_element_at("values", (F.pmod(F.col("horizon_step") - 1, F.lit(SEASON)) + 1).cast("int"))
    trend = F.col("_b") + F.col("_k") * (F.col("_n") + F.col("horizon_step") - 1)
    short, long = F.size("values") < MINIMUM, F.size("values") >= SEASON
    return steps.select(
        *keys, "metric_type", "horizon_step",
        F.when(short, last).when(long, seasonal).otherwise(trend).alias("base_forecast_value"),
        F.when(short, "insufficient_data").when(long, "fallback_naive").otherwise("fallback_trend").alias("model_status"),
    )


def calibrate(forecast: DataFrame, bias: DataFrame) -> DataFrame:
    """base, bias (0 when unknown), their sum; non-finite values become NULL."""
    keys = ["device_id", "location_id", "metric_type"]
    j = forecast.join(bias.select(*keys, "bias_value", "sample_count"), keys, "left")
    j = j.withColumns({"bias_value": F.coalesce("bias_value", F.lit(0.0)), "sample_count": F.coalesce("sample_count", F.lit(0))})
    final = finite(F.col("base_forecast_value") + F.col("bias_value"))
    return j.withColumns({
        "base_forecast_value": finite(F.col("base_forecast_value")),
        "forecast_value": final,
        "calibrated_forecast_value": final,
    })


def calibration_profile(entities: DataFrame, bias: DataFrame, days: int, at: Column) -> DataFrame:
    grid = entities.select("device_id", "location_id").distinct().withColumn(
        "metric_type", F.explode(F.array(*[F.lit(m) for m in METRICS]))
    )
    j = grid.join(bias, ["device_id", "location_id", "metric_type"], "left")
    return j.select(
        "device_id", "location_id", "metric_type", F.coalesce("bias_value", F.lit(0.0)).alias("bias_value"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"), F.lit(days).alias("window_days"), at.alias("updated_at"),
    )


def forecast_wide(fc: DataFrame, keys: list[str], latest: bool = True) -> DataFrame:
    """One row per key and time with both metrics and their models; newest batch per metric first."""
    src = latest_batch(fc, [*keys, "metric_type"], "generated_at") if latest else fc
    v = F.coalesce("calibrated_forecast_value", "forecast_value")
    pick = lambda c, m: F.max(F.when(F.col("metric_type") == m, c))
    return src.groupBy(*keys, F.col("forecast_timestamp").alias("forecast_ts")).agg(
        *[pick(v, m).alias(m) for m in METRICS],
        F.max("generated_at").alias("generated_at"),
        *[pick(F.col(c), m).alias(f"{m}_{c}") for c in ("model_name", "model_type") for m in METRICS],
    )


def forecast_wide_legacy(fc: DataFrame, value: str = "y_pred", sensor: str = "sensor_id") -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("metric_type") == m, F.col(value)))
    return fc.groupBy(sensor, "forecast_ts").agg(*[pick(m).alias(m) for m in METRICS])


def forecast_head(wide: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First n times per key, oldest first."""
    return keep_first(wide, keys, [F.col("forecast_ts").asc()], n)


def forecast_snapshot(wide: DataFrame, keys: list[str]) -> DataFrame:
    """First row with a temperature, else the first row."""
    return keep_first(wide, keys, [F.col("temperature").isNull().asc(), F.col("forecast_ts").asc()])


def forecast_coverage(fc: DataFrame, keys: list[str]) -> DataFrame:
    return fc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("forecast_timestamp").alias("first_ts"),
        F.max("forecast_timestamp").alias("last_ts"), F.max("horizon_step").alias("max_horizon_step"),
    )


def fallback_all(history: DataFrame, entities: DataFrame, joined: DataFrame, horizon: int, as_of: Column, days: int):
    """Calibrated fallback forecast rows of every entity that has a history.

    A device without own history uses its place's series. Own and place series
    come from one pass over the history: every row counts for both.
    """
    own, place = F.col("device_id"), F.lit(None).cast("string")
    scoped = history.withColumn("scope", F.explode(F.array(own, place)))
    f = fallback_forecast(scoped, ["location_id", "scope"], horizon)
    # bring each entity to the one series it uses before fanning out to steps
    known = scoped.where(F.col("scope").isNotNull()).select(F.col("location_id").alias("_l"), F.col("scope").alias("_s")).distinct()
    used = entities.join(known, (F.col("location_id") == F.col("_l")) & (F.col("device_id") == F.col("_s")), "left").drop("_l")
    grid = forecast_grid(used, horizon, as_of)
    on = ["location_id", "metric_type", "horizon_step"]
    g, b = grid.alias("g"), f.alias("b")
    match = F.col("g._s").eqNullSafe(F.col("b.scope"))
    for c in on:
        match = (F.col(f"g.{c}") == F.col(f"b.{c}")) & match
    base = g.join(b, match).select(
        *[F.col(f"g.{c}") for c in grid.columns if c != "_s"], "b.base_forecast_value", "b.model_status"
    )
    return calibrate(base, recent_bias(joined, days, as_of))
