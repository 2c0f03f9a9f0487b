"""Multi-step jobs over a set of logical tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlake.operators import alerts, forecast, stations

YEAR, EXPECTED, MIN_COVERAGE = 2024, 720, 0.5


def station_observations(reference: DataFrame) -> DataFrame:
    """(station_id, row_count, metric_count): distinct hours and metrics that occur."""
    return reference.groupBy("station_id").agg(
        F.count_distinct("event_ts").alias("row_count"),
        (F.max(F.col("temperature_c").isNotNull().cast("int")) + F.max(F.col("relative_humidity").isNotNull().cast("int"))).alias("metric_count"),
    )


def station_candidates(v, year=YEAR, expected=EXPECTED, min_coverage=MIN_COVERAGE) -> DataFrame:
    return stations.candidates(
        v.dim_location, v.stations, station_observations(v.reference_raw), year, expected, min_coverage=min_coverage
    )


def forecast_scan(fc: DataFrame, devices: DataFrame, existing: DataFrame, as_of, hours: int = alerts.LOOKAHEAD_HOURS):
    """Scheduled scan: (new alerts, report per source)."""
    targets = alerts.forecast_devices(devices)
    breaches = alerts.first_breaches(fc, targets, as_of, hours)
    created = alerts.new_alerts(breaches, existing, as_of)
    return created, alerts.scan_report(fc, targets, breaches, created, as_of, hours)


def forecast_table(v, horizon: int, as_of, days: int) -> DataFrame:
    """Fallback forecast of every entity with calibration."""
    return forecast.fallback_all(v.series, v.entities, v.joined, horizon, as_of, days)
