"""Typing, quality, filters."""

from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import INPUTS, as_of, SQL_AS_OF
from hourlake.functions import measure
from hourlake.operators import features, history, matching, quality, stations
from hourlake.plans import jobs

DAY1, DAY2 = "2024-01-10", "2024-01-12"


@query("flagship_forecast", f"""
  SELECT device_id, location_id, province_id, metric_type, horizon_step, forecast_timestamp,
    {r('base_forecast_value')} AS base_forecast_value, {r('bias_value')} AS bias_value,
    {r('calibrated_forecast_value')} AS calibrated_forecast_value, model_status FROM forecast_rows""")
def flagship(v):
    return rounded(v.forecast_rows.select(
        "device_id", "location_id", "province_id", "metric_type", "horizon_step", "forecast_timestamp",
        "base_forecast_value", "bias_value", "calibrated_forecast_value", "model_status"))


@query("p1_project_raw", """
  SELECT device_id, location_id, province_id, TRY_CAST(ts_text AS TIMESTAMP) AS event_ts,
    TRY_CAST(t_text AS DOUBLE) AS temperature, humidity, TIMESTAMP '2024-01-31 00:00:00' AS ingest_time
  FROM (SELECT device_id, location_id, province_id, humidity,
    CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(event_ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
    CASE WHEN event_id % 5 = 0 THEN 'abc' ELSE CAST(temperature AS VARCHAR) END AS t_text FROM bronze_raw)""")
def p1(v):
    k = F.col("event_id")
    raw = v.bronze_raw.select(
        "device_id", "location_id", "province_id", "humidity",
        F.when(k % 7 == 0, "not a time").otherwise(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")).alias("event_ts"),
        F.when(k % 5 == 0, "abc").otherwise(F.col("temperature").cast("string")).alias("temperature"))
    return quality.project_raw(raw, as_of())


@query("p2_quality_flag", "SELECT event_id, quality_flag FROM silver")
def p2(v):
    return quality.with_flag(v.bronze_raw).select("event_id", "quality_flag")


@query("p2_quality_flag_strict", """
  SELECT event_id, CASE WHEN temperature IS NULL OR NOT (temperature BETWEEN -10 AND 60) THEN 'invalid_temperature'
    WHEN humidity IS NULL OR NOT (humidity BETWEEN 0 AND 100) THEN 'invalid_humidity' ELSE 'valid' END AS quality_flag
  FROM bronze_raw""")
def p2s(v):
    return quality.with_flag(v.bronze_raw, strict_nulls=True).select("event_id", "quality_flag")


@query("p3_clean_sensor", "SELECT event_id, device_id, event_ts, temperature, humidity, quality_flag FROM silver")
def p3(v):
    return v.silver.select("event_id", "device_id", "event_ts", "temperature", "humidity", "quality_flag")


@query("p3_clean_reference", f"""SELECT location_id, province_id, event_ts, {r('temperature_c')} AS temperature_c,
  {r('relative_humidity')} AS relative_humidity, quality_flag FROM reference""")
def p3r(v):
    return rounded(v.reference.select(
        "location_id", "province_id", "event_ts", "temperature_c", "relative_humidity", "quality_flag"))


@query("p4_require_reading", "SELECT id, sensor_id FROM readings WHERE event_ts IS NOT NULL AND coalesce(temperature, humidity) IS NOT NULL")
def p4(v):
    wide = v.metrics.select(
        "id", "sensor_id", "event_ts",
        *[F.when(F.col("metric_type") == m, F.col("metric_value")).alias(m) for m in ("temperature", "humidity")])
    return quality.require_reading(wide, "sensor_id").select("id", "sensor_id")


@query("p5_filter_location_set", """
  SELECT 'current' AS which, count(*) AS n FROM reference_raw WHERE starts_with(location_id, 'loc34_')
  UNION ALL SELECT 'legacy', count(*) FROM reference_raw WHERE NOT starts_with(location_id, 'loc34_')
  UNION ALL SELECT 'all', count(*) FROM reference_raw""")
def p5(v):
    n = lambda w: quality.filter_location_set(v.reference_raw, w).agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("which"), "n")
    return n("current").unionByName(n("legacy")).unionByName(n("all"))


@query("p6_filter_ids", """
  SELECT location_id, count(*) AS n FROM reference_raw
  WHERE location_id IN ('loc34_nation_3', 'loc_nation_4') GROUP BY 1""")
def p6(v):
    df = quality.filter_ids(v.reference_raw, "loc34_nation_3, loc_nation_4")
    return df.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query("p7_prefer", f"""SELECT location_id, device_id, hour_ts, {r('temperature')} AS temperature, {r('humidity')} AS humidity
  FROM preferred""")
def p7(v):
    return rounded(features.prefer(v.joined).select("location_id", "device_id", "hour_ts", "temperature", "humidity"))


@query("p8_history", f"""SELECT id, sensor_id, event_ts, metric_value FROM metrics
  WHERE metric_type = 'temperature' AND event_ts >= {SQL_AS_OF} - INTERVAL 4320 MINUTE""")
def p8(v):
    return history.history(v.metrics, "temperature", 4320, as_of()).select("id", "sensor_id", "event_ts", "metric_value")


@query("p9_history_by_date", f"""SELECT id, event_ts FROM metrics WHERE event_ts >= TIMESTAMP '{DAY1}' - INTERVAL 7 HOUR
  AND event_ts < TIMESTAMP '{DAY2}' + INTERVAL 1 DAY - INTERVAL 7 HOUR""")
def p9(v):
    return history.history_by_date(v.metrics, DAY1, DAY2).select("id", "event_ts")


@query("p10_resolve_window", f"""SELECT id, event_ts FROM metrics WHERE event_ts >= TIMESTAMP '{DAY1} 00:00:00'
  AND event_ts <= TIMESTAMP '{DAY2} 23:59:59.999999'""")
def p10(v):
    return history.between(v.metrics, history.resolve_window(DAY2, DAY1, 60, as_of())).select("id", "event_ts")


@query("p11_fresh_only", f"""SELECT id, sensor_id, event_ts, metric_value FROM (SELECT *,
    row_number() OVER (PARTITION BY sensor_id ORDER BY event_ts DESC, id DESC) AS rn FROM metrics)
  WHERE rn = 1 AND event_ts >= {SQL_AS_OF} - INTERVAL 86400 SECOND""")
def p11(v):
    return history.fresh_only(v.metrics, ["sensor_id"], 86_400, as_of()).select("id", "sensor_id", "event_ts", "metric_value")


_REASON = """CASE WHEN trim(sensor_id) = '' THEN 'blank_sensor_id'
    WHEN metric_type IS NULL OR metric_type NOT IN ('temperature','humidity','soil_moisture','light_intensity','pressure') THEN 'unknown_metric_type'
    WHEN metric_value IS NULL THEN 'missing_value' WHEN metric_value < 0 OR metric_value > 1000000 THEN 'value_out_of_bounds' END"""


@query("p12_validate_metrics", f"""
  SELECT coalesce({_REASON}, 'accepted') AS outcome, count(*) AS n FROM (
    SELECT CASE WHEN id % 11 = 0 THEN '  ' ELSE sensor_id END AS sensor_id,
      CASE WHEN id % 13 = 0 THEN 'noise' ELSE metric_type END AS metric_type,
      CASE WHEN id % 17 = 0 THEN -metric_value WHEN id % 19 = 0 THEN metric_value * 1e6 WHEN id % 23 = 0 THEN NULL ELSE metric_value END AS metric_value
    FROM metrics) GROUP BY 1""")
def p12(v):
    k, val = F.col("id"), F.col("metric_value")
    m = v.metrics.select(
        F.when(k % 11 == 0, "  ").otherwise(F.col("sensor_id")).alias("sensor_id"),
        F.when(k % 13 == 0, "noise").otherwise(F.col("metric_type")).alias("metric_type"),
        F.when(k % 17 == 0, -val).when(k % 19 == 0, val * 1e6).when(k % 23 == 0, None).otherwise(val).alias("metric_value"))
    ok, bad = quality.validate_metrics(m)
    both = ok.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reject_reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("p13_usable", f"""
  SELECT location_id, device_id, hour_ts FROM features WHERE temp_target_1 IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in INPUTS)}""")
def p13(v):
    return quality.usable(v.features, INPUTS, "temp_target_1").select("location_id", "device_id", "hour_ts")


@query("p14_alerts_query", f"""SELECT id, source, metric_type, status FROM alert_table
  WHERE created_at >= {SQL_AS_OF} - INTERVAL 360 HOUR AND resolved_at IS NULL AND metric_type = 'temperature'
    AND (contains(lower(metric_type), 'sensor_1') OR contains(lower(source), 'sensor_1') OR contains(lower(status), 'sensor_1')
      OR contains(lower(alert_origin), 'sensor_1'))""")
def p14(v):
    df = history.alerts_query(v.alert_table, as_of(), hours=360, unresolved=True, metric="temperature", text=" Sensor_1 ")
    return df.select("id", "source", "metric_type", "status")


@query("p15_alert_status", """
  SELECT m.id, CASE WHEN m.metric_value IS NULL OR d.min_threshold IS NULL OR d.max_threshold IS NULL THEN 'none'
    WHEN m.metric_value < d.min_threshold OR m.metric_value > d.max_threshold THEN 'out_of_range' ELSE 'normal' END AS alert_status
  FROM metrics m JOIN iot_devices d ON d.source = m.sensor_id""")
def p15(v):
    j = v.metrics.join(v.iot_devices.withColumnRenamed("source", "sensor_id").drop("id"), "sensor_id")
    return j.select("id", measure.alert_status(F.col("metric_value"), F.col("min_threshold"), F.col("max_threshold")).alias("alert_status"))


@query("p16_level_status", """
  SELECT id, CASE WHEN kind = 'cpu' AND value >= 90 OR kind = 'memory' AND value >= 95 THEN 'critical'
    WHEN kind = 'cpu' AND value >= 80 OR kind = 'memory' AND value >= 85 THEN 'warning' ELSE 'normal' END AS level
  FROM (SELECT event_id AS id, value, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' ELSE 'other' END AS kind FROM events)""")
def p16(v):
    kind = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "memory").otherwise("other")
    return v.events.select(F.col("event_id").alias("id"), measure.level_status(kind, F.col("value")).alias("level"))


@query("p17_future_only", f"""
  SELECT f.source, f.forecast_ts, {r('f.temperature')} AS temperature FROM sensor_forecast f
  LEFT JOIN (SELECT sensor_id, max(event_ts) AS last_ts FROM metrics
    WHERE event_ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-02-02' GROUP BY 1) a ON a.sensor_id = f.source
  WHERE f.forecast_ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-02-02'
    AND f.forecast_ts > greatest(coalesce(a.last_ts, {SQL_AS_OF}), {SQL_AS_OF})""")
def p17(v):
    span = (F.lit("2024-01-20").cast("timestamp"), F.lit("2024-02-02").cast("timestamp"))
    actual = v.metrics.withColumnRenamed("sensor_id", "source")
    out = history.future_only(v.sensor_forecast, actual, ["source"], as_of(), span)
    return rounded(out.select("source", "forecast_ts", "temperature"))


@query("p18_sensor_list", """
  WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_ts DESC, id DESC) AS rn FROM readings) WHERE rn = 1)
  SELECT viewer, d.id, d.source, l.event_ts AS latest_event_ts, l.temperature, l.humidity
  FROM (SELECT *, unnest(['user:' || user_id, 'admin']) AS viewer FROM iot_devices WHERE c_mktsegment <> 'MACHINERY') d
  LEFT JOIN last l ON l.sensor_id = d.source""")
def p18(v):
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "virtual_meteostat").otherwise("physical_iot")
    out = matching.sensor_list(v.iot_devices.withColumn("source_type", kind), v.readings)
    return out.select("viewer", "id", "source", "latest_event_ts", "temperature", "humidity")


@query("p19_reject_reason", """
  SELECT location_id, station_id, CASE
    WHEN NOT (coalesce(start_year, 2024) <= 2024 AND coalesce(end_year, 2024) >= 2024) THEN 'station_inventory_mismatch'
    WHEN distance_km > 200 THEN 'station_too_far' WHEN coalesce(row_count, 0) = 0 THEN 'station_no_rows'
    WHEN row_count / 720.0 < 0.5 THEN 'station_low_coverage' ELSE 'accepted' END AS reason
  FROM ranked_stations""")
def p19(v):
    return jobs.station_candidates(v).select("location_id", "station_id", "reason")


_AREASON = """CASE WHEN metric_type NOT IN ('cpu','memory','temperature','humidity','soil_moisture','light_intensity','pressure') THEN 'unknown_metric_type'
  WHEN status IS NULL OR status NOT IN ('warning','critical') THEN 'unknown_status' WHEN origin NOT IN ('realtime','forecast') THEN 'unknown_origin' END"""


@query("p20_validate_alerts", f"""
  SELECT coalesce({_AREASON}, 'accepted') AS outcome, count(*) AS n FROM (
    SELECT CASE WHEN id % 7 = 0 THEN 'noise' ELSE metric_type END AS metric_type, status,
      CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'realtime' END AS origin FROM evaluated) GROUP BY 1""")
def p20(v):
    from hourlake.operators.alerts import evaluate

    k = F.col("id")
    a = evaluate(v.metrics, v.iot_devices).select(
        F.when(k % 7 == 0, "noise").otherwise(F.col("metric_type")).alias("metric_type"), "status",
        F.when(k % 5 == 0, "manual").otherwise("realtime").alias("alert_origin"))
    ok, bad = quality.validate_alerts(a)
    both = ok.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reject_reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
