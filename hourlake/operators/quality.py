"""Typing, cleaning and validation of readings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import measure
from hourlake.operators.ranking import dedupe

ALL_WORDS = {"", "all", "*"}
METRIC_TYPES = ["temperature", "humidity", "soil_moisture", "light_intensity", "pressure"]
ALERT_METRIC_TYPES = ["cpu", "memory", *METRIC_TYPES]
MAX_METRIC_VALUE = 1_000_000.0


def project_raw(df: DataFrame, ingest_time: Column) -> DataFrame:
    """Typed readings; text that does not parse becomes NULL."""
    ids = [F.col(c).cast("string").alias(c) for c in ("device_id", "location_id", "province_id")]
    stamp = lambda c: F.try_to_timestamp(F.col(c).cast("string"))
    ingested = F.coalesce(stamp("ingest_time"), ingest_time) if "ingest_time" in df.columns else ingest_time
    return df.select(
        *ids,
        stamp("event_ts").alias("event_ts"),
        F.col("temperature").try_cast("double").alias("temperature"),
        F.col("humidity").try_cast("double").alias("humidity"),
        ingested.alias("ingest_time"),
    )


def with_flag(df, temperature="temperature", humidity="humidity", **kw) -> DataFrame:
    flag = measure.quality_flag(F.col("event_ts"), F.col(temperature), F.col(humidity), **kw)
    return df.withColumn("quality_flag", flag)


def clean_sensor(df: DataFrame, **kw) -> DataFrame:
    """Flagged readings that have a time."""
    return with_flag(df, **kw).where(F.col("event_ts").isNotNull())


def clean_reference(df: DataFrame, order: list[Column], **kw) -> DataFrame:
    """Valid reference rows, one per (location, time)."""
    flagged = with_flag(df, "temperature_c", "relative_humidity", **kw)
    valid = flagged.where(F.col("event_ts").isNotNull() & (F.col("quality_flag") == "valid"))
    return dedupe(valid, ["location_id", "event_ts"], order)


def require_reading(df, id_col="device_id", values=("temperature", "humidity")) -> DataFrame:
    """An id, a time, and at least one value."""
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return df.where(F.col(id_col).isNotNull() & F.col("event_ts").isNotNull() & some)


def filter_location_set(df: DataFrame, which: str = "all", prefix: str = "loc34_") -> DataFrame:
    w = which.strip().lower()
    hit = F.col("location_id").startswith(prefix)
    if w in ("current", "current_34", "34"):
        return df.where(hit)
    if w in ("legacy", "legacy_63", "63"):
        return df.where(~hit)
    return df


def filter_ids(df: DataFrame, ids: str, column: str = "location_id") -> DataFrame:
    """Comma list of ids; empty, `all` and `*` keep everything."""
    wanted = [i.strip() for i in ids.split(",") if i.strip()]
    if ids.strip().lower() in ALL_WORDS or any(i.lower() in ALL_WORDS for i in wanted):
        return df
    return df.where(F.col(column).isin(wanted))


def usable(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.dropna(subset=[*features, target])


def reason_metric() -> Column:
    v = F.col("metric_value")
    return (
        F.when(F.trim(F.coalesce("sensor_id", F.lit(""))) == "", "blank_sensor_id")
        .when(~F.coalesce(F.col("metric_type").isin(METRIC_TYPES), F.lit(False)), "unknown_metric_type")
        .when(v.isNull() | F.isnan(v), "missing_value")
        .when((v < 0.0) | (v > MAX_METRIC_VALUE), "value_out_of_bounds")
    )


def validate_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed id, rejected with reject_reason)."""
    marked = df.withColumn("reject_reason", reason_metric())
    ok = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return ok.withColumn("sensor_id", F.trim("sensor_id")), marked.where(F.col("reject_reason").isNotNull())


def reason_alert() -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    origin = F.coalesce(F.col("alert_origin"), F.lit("realtime"))
    return (
        F.when(no(F.col("metric_type").isin(ALERT_METRIC_TYPES)), "unknown_metric_type")
        .when(no(F.col("status").isin("warning", "critical")), "unknown_status")
        .when(no(origin.isin("realtime", "forecast")), "unknown_origin")
    )


def validate_alerts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reject_reason", reason_alert())
    ok = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return ok, marked.where(F.col("reject_reason").isNotNull())
