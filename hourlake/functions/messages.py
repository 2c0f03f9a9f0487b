"""Alert text for people."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
METRIC_LABELS = {
    "temperature": "Temperature",
    "humidity": "Humidity",
    "soil_moisture": "Soil moisture",
    "light_intensity": "Light intensity",
    "pressure": "Pressure",
}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def metric_label(metric: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(metric, F.lit(""))))
    out = F.when(key == "", "Unknown").otherwise(key)
    for name, label in METRIC_LABELS.items():
        out = F.when(key == name, label).otherwise(out)
    return out


def value_text(v: Column, unit: Column) -> Column:
    u = F.coalesce(unit, F.lit(""))
    return F.when(v.isNull(), "--").otherwise(F.trim(F.concat(F.format_string("%.2f", v), F.lit(" "), u)))


def range_text(lo: Column, hi: Column, unit: Column) -> Column:
    return (
        F.when(lo.isNull() & hi.isNull(), "--")
        .when(lo.isNull(), F.concat(F.lit("<= "), value_text(hi, unit)))
        .when(hi.isNull(), F.concat(F.lit(">= "), value_text(lo, unit)))
        .otherwise(F.concat(value_text(lo, unit), F.lit(" - "), value_text(hi, unit)))
    )


def _is_forecast() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("alert_origin"), F.lit("realtime")))) == "forecast"


def alert_text() -> Column:
    """Message body of an alert row; NULL times add no line."""
    at = lambda c: F.date_format(c, TIME_FORMAT)
    unit, fc = F.col("unit"), _is_forecast()
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v)
    return F.concat_ws(
        "\n",
        F.when(fc, "Forecast Alert").otherwise("IoT Alert"),
        line("Device", F.coalesce("device_name", "source", F.lit("Unknown"))),
        line("Source", F.coalesce("source", F.lit("Unknown"))),
        line("Metric", metric_label(F.col("metric_type"))),
        F.concat(
            F.when(fc, "Forecast value: ").otherwise("Current value: "),
            value_text(F.col("current_value"), unit),
        ),
        F.concat(
            F.lit("Threshold trigger: "),
            F.when(F.col("status") == "critical", "> ").otherwise("< "),
            value_text(F.col("threshold"), unit),
        ),
        line("Allowed range", range_text(F.col("min_threshold"), F.col("max_threshold"), unit)),
        F.when(F.col("status") == "critical", "Status: CRITICAL").otherwise("Status: WARNING"),
        line("Time", at("created_at")),
        line("Forecast time", at("forecast_timestamp")),
        line("Forecast generated at", at("forecast_generated_at")),
    )


def alert_subject() -> Column:
    return F.concat(
        F.when(_is_forecast(), "[Forecast] ").otherwise("[Alert] "),
        metric_label(F.col("metric_type")),
        F.lit(" out of range on "),
        F.coalesce("device_name", "source", F.lit("Unknown")),
    )
