"""Threshold and forecast alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import measure
from hourlake.operators.matching import attach_thresholds, new_rows, primary_by_source
from hourlake.operators.ranking import keep_first

LOOKAHEAD_HOURS = 24
DEDUPE_HOURS = 48
DEDUPE_KEYS = ["source", "metric_type", "status", "threshold", "forecast_timestamp"]


def evaluate(metrics: DataFrame, devices: DataFrame) -> DataFrame:
    """Every metric of an alerting device with its bounds and status (NULL = in range)."""
    m = attach_thresholds(metrics, devices)
    m = m.where(F.col("is_active") & F.col("alert_enabled"))
    lo, hi = measure.effective_bounds(F.col("metric_type"), F.col("device_type"))
    m = m.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    v = F.col("metric_value")
    status = measure.breach_status(v, F.col("_lo"), F.col("_hi"))
    return m.withColumn("status", status).select(
        "id",
        F.col("sensor_id").alias("source"),
        "metric_type",
        "event_ts",
        v.alias("current_value"),
        "status",
        F.when(F.col("status") == "critical", F.col("_hi")).when(F.col("status") == "warning", F.col("_lo")).alias("threshold"),
        F.col("device_id"),
        F.coalesce("device_name", "sensor_id").alias("device_name"),
        measure.default_unit(F.col("metric_type")).alias("unit"),
        F.col("_lo").alias("min_threshold"),
        F.col("_hi").alias("max_threshold"),
    )


def threshold_alerts(metrics: DataFrame, devices: DataFrame) -> DataFrame:
    """Breaches only."""
    return evaluate(metrics, devices).where(F.col("status").isNotNull())


def forecast_devices(devices: DataFrame) -> DataFrame:
    """Alerting devices with any per-metric bound, one per source."""
    some = F.coalesce(
        "temperature_min_threshold", "temperature_max_threshold", "humidity_min_threshold", "humidity_max_threshold"
    ).isNotNull()
    return primary_by_source(devices.where(F.col("is_active") & F.col("alert_enabled") & some))


def first_breaches(forecast: DataFrame, devices: DataFrame, as_of: Column, hours: int = LOOKAHEAD_HOURS) -> DataFrame:
    """First breach per (source, metric, direction) in (as_of, as_of + hours].

    `forecast` has source, forecast_ts, temperature, humidity, generated_at.
    """
    inside = (F.col("forecast_ts") > as_of) & (F.col("forecast_ts") <= as_of + F.expr(f"INTERVAL {int(hours)} HOURS"))
    j = forecast.where(inside).join(devices, "source")
    checks = []
    for m, unit in (("temperature", "C"), ("humidity", "%")):
        lo, hi = F.col(f"{m}_min_threshold"), F.col(f"{m}_max_threshold")
        for direction, bound, hit, status in (
            ("high", hi, F.col(m) > hi, "critical"),
            ("low", lo, F.col(m) < lo, "warning"),
        ):
            checks.append(
                F.when(
                    hit,
                    F.struct(
                        F.lit(m).alias("metric_type"),
                        F.lit(direction).alias("direction"),
                        F.lit(status).alias("status"),
                        F.col(m).alias("current_value"),
                        bound.alias("threshold"),
                        F.lit(unit).alias("unit"),
                        lo.alias("min_threshold"),
                        hi.alias("max_threshold"),
                    ),
                )
            )
    rows = j.select(
        "source",
        F.col("id").alias("device_id"),
        F.col("name").alias("device_name"),
        F.col("forecast_ts").alias("forecast_timestamp"),
        F.col("generated_at").alias("forecast_generated_at"),
        F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("b"),
    ).select("*", "b.*").drop("b")
    return keep_first(
        rows, ["source", "metric_type", "direction"], [F.col("forecast_timestamp").asc(), F.col("current_value").asc()]
    )


def recent_forecast_alerts(existing: DataFrame, as_of: Column, hours: int = DEDUPE_HOURS) -> DataFrame:
    return existing.where(
        (F.col("alert_origin") == "forecast") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    )


def new_alerts(cands: DataFrame, existing: DataFrame, as_of: Column, hours: int = DEDUPE_HOURS) -> DataFrame:
    """Candidates not raised already in the dedupe window."""
    return new_rows(cands, recent_forecast_alerts(existing, as_of, hours), DEDUPE_KEYS)


def scan_report(forecast, devices, breaches, created, as_of: Column, hours: int = LOOKAHEAD_HOURS) -> DataFrame:
    """Per source: forecast rows, rows in the window, first and last time, breaches, created, duplicates."""
    inside = (F.col("forecast_ts") > as_of) & (F.col("forecast_ts") <= as_of + F.expr(f"INTERVAL {int(hours)} HOURS"))
    seen = forecast.groupBy("source").agg(
        F.count(F.lit(1)).alias("forecast_rows"),
        F.count_if(inside).alias("rows_in_window"),
        F.min("forecast_ts").alias("first_forecast_ts"),
        F.max("forecast_ts").alias("last_forecast_ts"),
    )
    b = breaches.groupBy("source").agg(F.count(F.lit(1)).alias("breaches"))
    c = created.groupBy("source").agg(F.count(F.lit(1)).alias("created"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return (
        devices.select("source").join(seen, "source", "left").join(b, "source", "left").join(c, "source", "left")
        .select(
            "source", zero("forecast_rows"), zero("rows_in_window"), "first_forecast_ts", "last_forecast_ts",
            zero("breaches"), zero("created"),
            (F.coalesce("breaches", F.lit(0)) - F.coalesce("created", F.lit(0))).alias("duplicates"),
        )
    )


def auto_register(metrics: DataFrame, devices: DataFrame) -> DataFrame:
    """New (source, metric) pairs of sources owned by exactly one user, cloned from its first device."""
    pairs = metrics.select(F.col("sensor_id").alias("source"), F.col("metric_type").alias("device_type")).distinct()
    owner = devices.groupBy("source").agg(
        F.min("user_id").alias("_lo"), F.max("user_id").alias("_hi")
    ).where("_lo = _hi").select("source")
    known = devices.select("source", "device_type").distinct()
    template = keep_first(devices, ["source"], [F.col("id").asc()])
    # the template's own unit comes first, where it has one
    unit = measure.default_unit(F.col("device_type"))
    unit = F.coalesce(F.nullif(F.trim("unit"), F.lit("")), unit) if "unit" in devices.columns else unit
    fresh = pairs.join(known, ["source", "device_type"], "left_anti").join(owner, "source", "left_semi")
    return fresh.join(template.drop("device_type"), "source").select(
        "source", "device_type", "user_id", F.col("id").alias("template_id"), "name",
        unit.alias("unit"), F.lit(True).alias("is_active"), F.lit(False).alias("alert_enabled"),
    )
