"""Table maintenance."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import as_of, SQL_AS_OF
from hourlake.operators import history, rollup, tables
from hourlake.session import shared_dir

SILVER = T.StructType([
    T.StructField("device_id", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("temperature", T.FloatType()),
    T.StructField("ingest_time", T.TimestampType()), T.StructField("quality_flag", T.StringType())])


@query("k1_conform", """SELECT device_id, CAST(event_id AS VARCHAR) AS event_id, CAST(CAST(temperature AS FLOAT) AS DOUBLE) AS temperature,
  CAST(NULL AS TIMESTAMP) AS ingest_time, quality_flag FROM silver""")
def k1(v):
    return tables.conform(v.silver, SILVER).withColumn("temperature", F.col("temperature").cast("double"))


def _halves(v):
    """Stored devices and an incoming change set that overlaps it."""
    d = v.iot_devices.select("id", "source", "device_type", "min_threshold")
    target = d.where("id % 3 <> 1")
    source = d.where("id % 2 = 0").withColumn("min_threshold", F.col("min_threshold") + 1.0)
    return target, source


_T = "(SELECT id, source, device_type, min_threshold FROM iot_devices WHERE id % 3 <> 1)"
_C = "(SELECT id, source, device_type, min_threshold + 1.0::DOUBLE AS min_threshold FROM iot_devices WHERE id % 2 = 0)"


@query("k2_upsert", f"SELECT * FROM {_C} UNION ALL SELECT * FROM {_T} WHERE id NOT IN (SELECT id FROM {_C})")
def k2(v):
    return tables.upsert(*_halves(v), ["id"])


@query("k3_replace_where", f"""SELECT * FROM {_C} WHERE device_type <> 'humidity'
  UNION ALL SELECT * FROM {_T} WHERE device_type NOT IN (SELECT device_type FROM {_C} WHERE device_type <> 'humidity')""")
def k3(v):
    target, source = _halves(v)
    return tables.replace_where(target, source.where("device_type <> 'humidity'"), ["device_type"])


@query("k4_update_where", """SELECT id, CASE WHEN min_threshold IS NULL THEN 1.5 ELSE min_threshold END AS min_threshold,
  CASE WHEN min_threshold IS NULL THEN false ELSE is_active END AS is_active FROM iot_devices""")
def k4(v):
    out = tables.update_where(v.iot_devices, F.col("min_threshold").isNull(), {"is_active": F.lit(False)})
    out = tables.update_where(out, F.col("min_threshold").isNull(), {"min_threshold": F.lit(1.5)})
    return out.select("id", "min_threshold", "is_active")


@query("k5_flag_matching", """SELECT id, coalesce(user_id, -1) IN (SELECT user_id FROM users WHERE user_id > 6) OR is_active AS is_active
  FROM (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE user_id END AS user_id, is_active FROM iot_devices)""")
def k5(v):
    d = v.iot_devices.withColumn("user_id", F.when(F.col("id") % 5 != 0, F.col("user_id")))
    return tables.flag_matching(d, v.users.where("user_id > 6"), {"user_id": -1}, "is_active").select("id", "is_active")


@query("k6_rebuild_on_drift", """SELECT 'drifted' AS kind, province_id, is_active FROM dim_province
  UNION ALL SELECT 'missing', province_id, is_active FROM dim_province
  UNION ALL SELECT 'complete', province_id, NULL FROM dim_province WHERE region = 'ASIA'""")
def k6(v):
    """Tables without a required column, without anything, and with all columns, each offered the full rows."""
    lake = tables.Lake(v.spark, f"{shared_dir(v.spark)}/drift-{uuid.uuid4().hex}")
    full = v.dim_province.select("province_id", "is_active")
    lake.write("drifted", full.select("province_id"))
    lake.write("complete", full.join(v.dim_province.where("region = 'ASIA'").select("province_id"), "province_id").withColumn("is_active", F.lit(None).cast("boolean")))
    out = []
    for kind in ("drifted", "missing", "complete"):
        tables.rebuild_on_drift(lake, kind, full, ["province_id", "is_active"])
        out.append(lake.table(kind).select(F.lit(kind).alias("kind"), "province_id", "is_active"))
    return tables.union_rows(out)


@query("s3_scan_table", "SELECT 'stored' AS kind, province_id, province_name FROM dim_province UNION ALL SELECT 'refused', 'absent', NULL")
def s3(v):
    """A stored table by name, a missing one with a schema (no rows), and a missing one without (refused)."""
    lake = tables.Lake(v.spark, f"{shared_dir(v.spark)}/scan-{uuid.uuid4().hex}")
    lake.write("provinces", v.dim_province.select("province_id", "province_name"))
    stored = lake.table("provinces")
    out = [stored.withColumn("kind", F.lit("stored")), lake.table("absent", stored.schema).withColumn("kind", F.lit("default"))]
    try:
        lake.table("absent")
    except FileNotFoundError:
        out.append(stored.agg(F.lit("absent").alias("province_id"), F.lit(None).cast("string").alias("province_name"), F.lit("refused").alias("kind")))
    return tables.union_rows(out).select("kind", "province_id", "province_name")


@query("k7_evolve", "SELECT province_id, province_name, CAST(NULL AS DOUBLE) AS altitude, is_active FROM dim_province")
def k7(v):
    new = T.StructType([T.StructField("altitude", T.DoubleType()), T.StructField("is_active", T.BooleanType())])
    return tables.evolve(v.dim_province, new).select("province_id", "province_name", "altitude", "is_active")


@query("k9_cluster", f"SELECT location_id, event_ts, {r('temperature_c')} AS temperature_c FROM reference")
def k9(v):
    return rounded(tables.cluster(v.reference, ["location_id", "event_ts"]).select("location_id", "event_ts", "temperature_c"))


@query("k9_zorder", f"SELECT location_id, event_ts, {r('temperature_c')} AS temperature_c FROM reference")
def k9z(v):
    """Written in Z-order of place and time, and read again."""
    path = f"{shared_dir(v.spark)}/zorder-{uuid.uuid4().hex}"
    tables.zorder_write(v.reference, ["location_id", "event_ts"], path)
    return rounded(v.spark.read.parquet(path).select("location_id", "event_ts", "temperature_c"))


@query("k10_retain", f"SELECT id, event_ts FROM metrics WHERE event_ts >= {SQL_AS_OF} - INTERVAL 15 DAY")
def k10(v):
    return tables.retain(v.metrics, "event_ts", 15, as_of()).select("id", "event_ts")


@query("k11_to_long", """SELECT hour_ts, device_id, 'temperature' AS metric_type, temperature_max AS metric_value, 'C' AS unit FROM hourly WHERE temperature_max IS NOT NULL
  UNION ALL SELECT hour_ts, device_id, 'humidity', humidity_max, '%' FROM hourly WHERE humidity_max IS NOT NULL""")
def k11(v):
    wide = v.hourly.select("hour_ts", "device_id", F.col("temperature_max").alias("temperature"), F.col("humidity_max").alias("humidity"),
                           F.lit("C").alias("temperature_unit"), F.lit("%").alias("humidity_unit"))
    return rollup.to_long(wide, {"temperature": "temperature_unit", "humidity": "humidity_unit"}, ["hour_ts", "device_id"])


@query("k12_export_frame", """SELECT rd.sensor_id, coalesce(d.name, '') AS device_name, strftime(rd.event_ts, '%Y-%m-%dT%H:%M:%S') AS event_ts,
  coalesce(CAST(temperature AS VARCHAR), '') AS temperature, coalesce(CAST(humidity AS VARCHAR), '') AS humidity
  FROM readings rd LEFT JOIN iot_devices d ON d.source = rd.sensor_id WHERE rd.event_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59.999999'""")
def k12(v):
    rows = history.between(v.readings, history.resolve_window("2024-01-10", "2024-01-12", 60, as_of()))
    return history.export_frame(rows, v.iot_devices)


@query("k14_resolve_alerts", f"""SELECT id, CASE WHEN status = 'warning' THEN {SQL_AS_OF} ELSE resolved_at END AS resolved_at FROM alert_table""")
def k14(v):
    return tables.resolve_alerts(v.alert_table, v.alert_table.where("status = 'warning'"), as_of()).select("id", "resolved_at")


@query("m13_replace_forecast", f"""SELECT device_id, metric_type, horizon_step, {r("CASE WHEN metric_type = 'humidity' THEN forecast_value + 1 ELSE forecast_value END")} AS forecast_value
  FROM forecast_rows""")
def m13(v):
    f = v.forecast_table.select("device_id", "metric_type", "horizon_step", "forecast_value")
    new = f.where("metric_type = 'humidity'").withColumn("forecast_value", F.col("forecast_value") + 1.0)
    return rounded(tables.replace_where(f, new, ["metric_type", "device_id"]))
