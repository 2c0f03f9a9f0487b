"""Logical tables over the given Parquet files, as DataFrames and as SQL.

The given tables hold no sensor data, so events stand for sensor messages,
line items for reference weather, customers for devices, suppliers for stations
and nations for places.
"""

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.functions import when
from hourlake.operators import alerts, evaluation, features, forecast, matching, quality, rollup, tables
from hourlake.session import code_version, exists, input_version, remove, shared_dir
from hourlake.operators.ranking import oldest
from hourlake.plans.training import CYCLIC, NUMERIC
from hourlake.functions.models import default_ids

#: Model inputs as the feature table has them; its cyclic ones follow from the calendar.
INPUTS = [c for c in NUMERIC if c not in CYCLIC]
AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    """The moment all queries take as now."""
    return F.lit(AS_OF_TEXT).cast("timestamp")


SQL_AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"
REFERENCE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "station_id", "temperature_c", "relative_humidity"]
BIAS_DAYS = 30
HORIZON = 168
EXPECTED_HOURS = 720
METRIC_OF = {
    "click": "temperature",
    "view": "humidity",
    "purchase": "pressure",
    "signup": "soil_moisture",
    "error": "light_intensity",
}


def _case(col: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(col == k, v).otherwise(out)
    return out


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """Layer table: written once for each version of the input files, and shared by all readers.

        The folder is named by table and input folder, its versions by a digest of the input
        files' names, sizes and times and one of the library's code. Writing a new version removes
        the older ones.
        """
        place = f"{shared_dir(self.spark)}/layers/{name}-{hashlib.md5(self.dir.encode()).hexdigest()[:12]}"
        path = f"{place}/{input_version(self.spark, self.dir)}-{code_version()}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            remove(self.spark, place)
            tables.write_table(df, path)
        return self.spark.read.parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", when.as_ts("ts"))

    @cached_property
    def dim_location(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.read("nation").select(
            F.concat(F.when(k % 5 == 4, "loc_").otherwise("loc34_"), F.lower("n_name")).alias("location_id"),
            F.concat(F.lit("prov_"), k).alias("province_id"),
            F.col("n_name").alias("location_name"),
            (F.lit(8.5) + F.lit(0.55) * k).alias("latitude"),
            (F.lit(102.5) + F.lit(0.27) * ((k * 7) % 25)).alias("longitude"),
            (k + 5).cast("double").alias("altitude"),
            "n_nationkey",
        )

    @cached_property
    def dim_province(self) -> DataFrame:
        j = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        k = F.col("n_nationkey")
        return j.select(
            F.concat(F.lit("prov_"), k).alias("province_id"),
            F.col("n_name").alias("province_name"),
            F.col("r_name").alias("region"),
            F.when(k % 6 == 5, False).when(k % 6 == 4, F.lit(None)).otherwise(True).alias("is_active"),
        )

    @cached_property
    def dim_device(self) -> DataFrame:
        return self.dim_location.select(F.concat(F.lit("gw_"), "n_nationkey").alias("device_id"), "location_id")

    @cached_property
    def bronze_raw(self) -> DataFrame:
        e = self.events.where(F.col("event_type").isin("click", "view"))
        c = self.read("customer").select("c_custkey", "c_nationkey")
        l = self.dim_location.select("location_id", "province_id", "n_nationkey")
        j = e.join(c, F.col("user_id") == F.col("c_custkey")).join(l, F.col("c_nationkey") == F.col("n_nationkey"))
        return j.select(
            F.concat(F.lit("gw_"), "c_nationkey").alias("device_id"),
            "location_id",
            "province_id",
            F.col("ts").alias("event_ts"),
            F.when(F.col("event_type") == "click", F.col("value")).alias("temperature"),
            F.when(F.col("event_type") == "view", F.col("value")).alias("humidity"),
            "event_id",
            F.concat(F.lit("sensor_"), "user_id").alias("sensor_id"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("event_ts"),
            F.concat(F.lit("sensor_"), "user_id").alias("sensor_id"),
            _case(F.col("event_type"), METRIC_OF).alias("metric_type"),
            F.col("value").alias("metric_value"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Wide readings: one value per row."""
        m = self.metrics.where(F.col("metric_type").isin("temperature", "humidity"))
        pick = lambda t: F.when(F.col("metric_type") == t, F.col("metric_value")).alias(t)
        return m.select("id", "sensor_id", "event_ts", pick("temperature"), pick("humidity"))

    @cached_property
    def reference_raw(self) -> DataFrame:
        li = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"
        )
        l = self.dim_location.select("location_id", "province_id", "n_nationkey")
        hour = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 720
        n = F.col("l_linenumber")
        return li.join(l, F.col("n_nationkey") == F.col("l_partkey") % 25).select(
            "location_id",
            "province_id",
            F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + hour * 3600).alias("event_ts"),
            (F.col("l_quantity") + F.when(n == 7, 30).otherwise(0)).alias("temperature_c"),
            F.when((n == 1) & (F.col("l_returnflag") == "N"), None).otherwise(F.col("l_discount") * 1000).alias("relative_humidity"),
            F.col("l_suppkey").alias("station_id"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )

    @cached_property
    def stations(self) -> DataFrame:
        l = self.dim_location.select("latitude", "longitude", "n_nationkey")
        k = F.col("s_suppkey")
        off = lambda f: (((k * f) % 200 - 100) / F.lit(50.0)).cast("double")
        dark = k % 7 == 0
        return self.read("supplier").join(l, F.col("s_nationkey") == F.col("n_nationkey")).select(
            k.alias("station_id"),
            F.col("s_name").alias("station_name"),
            "s_nationkey",
            (F.col("latitude") + off(37)).alias("latitude"),
            (F.col("longitude") + off(53)).alias("longitude"),
            F.when(~dark, 2020 + k % 5).alias("start_year"),
            F.when(~dark, 2023 + k % 3).alias("end_year"),
        )

    @cached_property
    def iot_devices(self) -> DataFrame:
        k = F.col("c_custkey")
        unless = lambda m, v: F.when(k % m != 0, v)
        return self.read("customer").select(
            k.alias("id"),
            (k % 10).alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("sensor_"), k).alias("source"),
            F.when(k % 3 == 0, "temperature_humidity").when(k % 3 == 1, "temperature").otherwise("humidity").alias("device_type"),
            "c_mktsegment",
            "c_nationkey",
            (k % 11 != 0).alias("is_active"),
            (k % 4 != 0).alias("alert_enabled"),
            unless(13, 5.0).alias("temperature_min_threshold"),
            F.lit(60.0).alias("temperature_max_threshold"),
            F.lit(10.0).alias("humidity_min_threshold"),
            unless(17, 80.0).alias("humidity_max_threshold"),
            unless(3, 8.0).alias("min_threshold"),
            unless(3, 70.0).alias("max_threshold"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.iot_devices.select("user_id").distinct().withColumn("is_admin", F.col("user_id") == 0)

    @cached_property
    def chat_messages(self) -> DataFrame:
        c = F.col("conv_id")
        base = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
        return self.read("conversations").select(
            c.alias("conversation_id"),
            "turn",
            F.when(F.col("role") == "assistant", "admin").otherwise(F.col("role")).alias("sender_type"),
            F.col("text").alias("content"),
            F.timestamp_seconds(base + c * 3600 + F.col("turn") * 60).alias("created_at"),
        )

    @cached_property
    def chat_conversations(self) -> DataFrame:
        k = F.col("id")
        base = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
        return self.chat_messages.select(F.col("conversation_id").alias("id")).distinct().select(
            "id",
            F.when(k % 5 != 0, F.timestamp_seconds(base + k * 3600 + (k % 4) * 60)).alias("last_read_by_user_at"),
            F.when(k % 3 != 0, F.timestamp_seconds(base + k * 3600 + 60)).alias("last_read_by_admin_at"),
        )

    # derived tables

    @cached_property
    def silver(self) -> DataFrame:
        return quality.clean_sensor(self.bronze_raw)

    @cached_property
    def hourly(self) -> DataFrame:
        return rollup.hourly_rollup(self.silver)

    @cached_property
    def reference(self) -> DataFrame:
        return quality.clean_reference(self.reference_raw, oldest(*REFERENCE_ORDER))

    @cached_property
    def joined(self) -> DataFrame:
        return matching.join_weather(self.reference, self.hourly)

    @cached_property
    def features(self) -> DataFrame:
        return features.build_features(self.joined, horizons=(1, 168))

    @cached_property
    def series(self) -> DataFrame:
        """Hourly history with default ids, for forecasting."""
        return default_ids(features.one_per_hour(features.prefer(self.joined)))

    @cached_property
    def model_metrics(self) -> DataFrame:
        return evaluation.baseline_metrics(self.series, F.lit("2024-01-30 00:00:00").cast("timestamp"))

    @cached_property
    def entities(self) -> DataFrame:
        return matching.forecast_entities(self.dim_device, self.dim_location)

    @cached_property
    def model_table(self) -> DataFrame:
        return self.stored("model_metrics", self.model_metrics)

    @cached_property
    def forecast_rows(self) -> DataFrame:
        joined = self.stored("weather_joined", self.joined)
        history = default_ids(features.one_per_hour(features.prefer(joined)))
        f = forecast.fallback_all(history, self.entities, joined, HORIZON, as_of(), BIAS_DAYS)
        return f.withColumns({
            "model_name": F.lit("fallback"),
            "model_type": F.lit("baseline"),
            "generated_at": as_of(),
        })

    @cached_property
    def forecast_table(self) -> DataFrame:
        return self.stored("forecast_result", self.forecast_rows)

    @cached_property
    def threshold_alerts(self) -> DataFrame:
        return alerts.threshold_alerts(self.metrics, self.iot_devices)

    @cached_property
    def alert_table(self) -> DataFrame:
        """Stored alerts: every realtime breach; every third is resolved, every fifth has no device."""
        k = F.col("id")
        return self.threshold_alerts.select(
            "id", "metric_type", "status", "current_value", "threshold", "source",
            F.when(k % 5 != 0, F.col("device_id")).alias("device_id"),
            "device_name", "unit", "min_threshold", "max_threshold",
            F.lit("realtime").alias("alert_origin"),
            F.lit(None).cast("timestamp").alias("forecast_timestamp"),
            F.lit(None).cast("timestamp").alias("forecast_generated_at"),
            F.col("event_ts").alias("created_at"),
            F.when(k % 3 == 0, F.timestamp_seconds(F.unix_seconds("event_ts") + 3600)).alias("resolved_at"),
        )

    @cached_property
    def generic_devices(self) -> DataFrame:
        """Second device table: suppliers as shared sources."""
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            k.alias("id"), F.concat(F.lit("sensor_"), k).alias("source"), (k % 10).alias("created_by"),
            (k % 4 != 1).alias("is_active"),
            F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("hall "), k)).alias("location"),
        )

    @cached_property
    def wide_forecast(self) -> DataFrame:
        """Forecasts of the gateways, per source (device) and time."""
        return forecast.forecast_wide(self.forecast_table, ["device_id", "location_id"])

    @cached_property
    def source_gateway(self) -> DataFrame:
        """Every device source and the gateway of its nation, whose forecast it follows."""
        return self.iot_devices.select("source", F.concat(F.lit("gw_"), "c_nationkey").alias("device_id"))

    @cached_property
    def sensor_forecast(self) -> DataFrame:
        """Forecast of every device source: the series of its nation's gateway."""
        # dealt out first: a few MB of sources would become all their forecasts in one task
        dealt = self.source_gateway.repartition(matching.shuffle_partitions(self.iot_devices), "source")
        return dealt.join(self.wide_forecast, "device_id").select(
            "source", "forecast_ts", "temperature", "humidity", "generated_at"
        )


_FRAME = "PARTITION BY location_id, device_id ORDER BY hour_ts"

CTES: dict[str, str] = {
    "dim_location": """
  SELECT (CASE WHEN n_nationkey % 5 = 4 THEN 'loc_' ELSE 'loc34_' END) || lower(n_name) AS location_id,
    'prov_' || n_nationkey AS province_id, n_name AS location_name,
    CAST(8.5 AS DOUBLE) + CAST(0.55 AS DOUBLE) * n_nationkey AS latitude,
    CAST(102.5 AS DOUBLE) + CAST(0.27 AS DOUBLE) * ((n_nationkey * 7) % 25) AS longitude,
    CAST(5 + n_nationkey AS DOUBLE) AS altitude, n_nationkey
  FROM nation""",
    "dim_province": """
  SELECT 'prov_' || n_nationkey AS province_id, n_name AS province_name, r_name AS region,
    CASE n_nationkey % 6 WHEN 5 THEN false WHEN 4 THEN NULL ELSE true END AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dim_device": "SELECT 'gw_' || n_nationkey AS device_id, location_id FROM dim_location",
    "bronze_raw": """
  SELECT 'gw_' || c_nationkey AS device_id, l.location_id, l.province_id, ts AS event_ts,
    CASE WHEN event_type = 'click' THEN value END AS temperature,
    CASE WHEN event_type = 'view' THEN value END AS humidity,
    event_id, 'sensor_' || user_id AS sensor_id
  FROM events JOIN customer ON user_id = c_custkey JOIN dim_location l ON l.n_nationkey = c_nationkey
  WHERE event_type IN ('click', 'view')""",
    "metrics": """
  SELECT event_id AS id, ts AS event_ts, 'sensor_' || user_id AS sensor_id,
    CASE event_type WHEN 'click' THEN 'temperature' WHEN 'view' THEN 'humidity' WHEN 'purchase' THEN 'pressure'
      WHEN 'signup' THEN 'soil_moisture' WHEN 'error' THEN 'light_intensity' END AS metric_type,
    value AS metric_value
  FROM events""",
    "readings": """
  SELECT id, sensor_id, event_ts, CASE WHEN metric_type = 'temperature' THEN metric_value END AS temperature,
    CASE WHEN metric_type = 'humidity' THEN metric_value END AS humidity
  FROM metrics WHERE metric_type IN ('temperature', 'humidity')""",
    "reference_raw": """
  SELECT l.location_id, l.province_id,
    TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey * 7 + l_linenumber * 131) % 720 AS INT)) AS event_ts,
    l_quantity + CASE WHEN l_linenumber = 7 THEN 30 ELSE 0 END AS temperature_c,
    CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN NULL ELSE l_discount * 1000 END AS relative_humidity,
    l_suppkey AS station_id, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN dim_location l ON l.n_nationkey = l_partkey % 25""",
    "stations": """
  SELECT s_suppkey AS station_id, s_name AS station_name, s_nationkey,
    l.latitude + ((s_suppkey * 37) % 200 - 100) / CAST(50.0 AS DOUBLE) AS latitude,
    l.longitude + ((s_suppkey * 53) % 200 - 100) / CAST(50.0 AS DOUBLE) AS longitude,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 2020 + s_suppkey % 5 END AS start_year,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 2023 + s_suppkey % 3 END AS end_year
  FROM supplier JOIN dim_location l ON l.n_nationkey = s_nationkey""",
    "iot_devices": """
  SELECT c_custkey AS id, c_custkey % 10 AS user_id, c_name AS name, 'sensor_' || c_custkey AS source,
    CASE c_custkey % 3 WHEN 0 THEN 'temperature_humidity' WHEN 1 THEN 'temperature' ELSE 'humidity' END AS device_type,
    c_mktsegment, c_nationkey, c_custkey % 11 <> 0 AS is_active, c_custkey % 4 <> 0 AS alert_enabled,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 5.0::DOUBLE END AS temperature_min_threshold,
    60.0::DOUBLE AS temperature_max_threshold, 10.0::DOUBLE AS humidity_min_threshold,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 80.0::DOUBLE END AS humidity_max_threshold,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 8.0::DOUBLE END AS min_threshold,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 70.0::DOUBLE END AS max_threshold
  FROM customer""",
    "users": "SELECT DISTINCT user_id, user_id = 0 AS is_admin FROM iot_devices",
    "chat_messages": """
  SELECT conv_id AS conversation_id, turn, CASE role WHEN 'assistant' THEN 'admin' ELSE role END AS sender_type,
    text AS content,
    TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS created_at
  FROM conversations""",
    "chat_conversations": """
  SELECT conversation_id AS id,
    CASE WHEN conversation_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(conversation_id AS INT))
      + to_minutes(CAST(conversation_id % 4 AS INT)) END AS last_read_by_user_at,
    CASE WHEN conversation_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(conversation_id AS INT))
      + to_minutes(1) END AS last_read_by_admin_at
  FROM (SELECT DISTINCT conversation_id FROM chat_messages)""",
    "silver": """
  SELECT *, CASE WHEN event_ts IS NULL THEN 'invalid_timestamp'
      WHEN NOT (temperature BETWEEN -10 AND 60) THEN 'invalid_temperature'
      WHEN NOT (humidity BETWEEN 0 AND 100) THEN 'invalid_humidity' ELSE 'valid' END AS quality_flag
  FROM bronze_raw WHERE event_ts IS NOT NULL""",
    "hourly": """
  SELECT device_id, location_id, province_id, date_trunc('hour', event_ts) AS hour_ts,
    avg(temperature) AS temperature_avg, min(temperature) AS temperature_min, max(temperature) AS temperature_max,
    avg(humidity) AS humidity_avg, min(humidity) AS humidity_min, max(humidity) AS humidity_max,
    CAST(count(*) AS INT) AS record_count,
    greatest(CAST(0 AS DOUBLE), 1 - count(*) / CAST(720 AS DOUBLE)) AS missing_ratio
  FROM silver WHERE quality_flag = 'valid' GROUP BY 1, 2, 3, 4""",
    "reference": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, 'valid' AS quality_flag, row_number() OVER (PARTITION BY location_id, event_ts
      ORDER BY l_orderkey, l_linenumber, l_partkey, station_id, temperature_c NULLS LAST, relative_humidity NULLS LAST) AS rn
    FROM reference_raw
    WHERE coalesce(temperature_c BETWEEN -10 AND 60, true) AND coalesce(relative_humidity BETWEEN 0 AND 100, true))
  WHERE rn = 1""",
    "joined": """
  SELECT m.location_id, m.province_id, s.device_id, date_trunc('hour', m.event_ts) AS hour_ts,
    s.temperature_avg AS esp32_temperature_avg, s.humidity_avg AS esp32_humidity_avg,
    m.temperature_c AS meteostat_temperature, m.relative_humidity AS meteostat_humidity
  FROM reference m LEFT JOIN hourly s
    ON s.location_id = m.location_id AND s.hour_ts = date_trunc('hour', m.event_ts)""",
    "preferred": """
  SELECT location_id, province_id, device_id, hour_ts,
    coalesce(esp32_temperature_avg, meteostat_temperature) AS temperature,
    coalesce(esp32_humidity_avg, meteostat_humidity) AS humidity, meteostat_temperature, meteostat_humidity
  FROM joined
  WHERE hour_ts IS NOT NULL AND coalesce(esp32_temperature_avg, meteostat_temperature) IS NOT NULL
    AND coalesce(esp32_humidity_avg, meteostat_humidity) IS NOT NULL""",
    "base_series": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY location_id, device_id, hour_ts ORDER BY temperature DESC NULLS LAST,
      humidity DESC NULLS LAST, meteostat_temperature DESC NULLS LAST, meteostat_humidity DESC NULLS LAST,
      province_id DESC NULLS LAST) AS rn FROM preferred)
  WHERE rn = 1""",
    "features": f"""
  SELECT *, hour(hour_ts) AS hour, dayofweek(hour_ts) + 1 AS day_of_week, month(hour_ts) AS month,
    {", ".join(f"lag({c}, {k}) OVER w AS {s}_lag_{k}" for c, s in (("temperature", "temp"), ("humidity", "humidity")) for k in (1, 6, 12, 24))},
    {", ".join(f"avg({c}) OVER ({_FRAME} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {s}_rolling_{n}" for c, s in (("temperature", "temp"), ("humidity", "humidity")) for n in (24, 168))},
    {", ".join(f"lead({c}, {h}) OVER w AS {s}_target_{h}" for c, s in (("temperature", "temp"), ("humidity", "humidity")) for h in (1, 168))}
  FROM base_series WINDOW w AS ({_FRAME})""",
    "series": """
  SELECT coalesce(location_id, 'unknown') AS location_id, coalesce(province_id, 'unknown') AS province_id,
    coalesce(device_id, 'meteostat_only') AS device_id, hour_ts, temperature, humidity, meteostat_temperature, meteostat_humidity
  FROM base_series""",
    "predictions": f"""
  WITH p AS (SELECT *, {", ".join(
      f"lag({t}, 1) OVER w AS last_value_{t}, lag({t}, 168) OVER w AS seasonal_168_{t}, "
      f"avg({t}) OVER ({_FRAME} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_24_{t}"
      for t in ("temperature", "humidity"))}
    FROM series WINDOW w AS ({_FRAME}))
  {" UNION ALL ".join(
      f"SELECT location_id, device_id, hour_ts, '{m}' AS model_name, '{t}' AS target_variable, {t} AS label, {m}_{t} AS prediction FROM p"
      for m in ("last_value", "seasonal_168", "rolling_24") for t in ("temperature", "humidity"))}""",
    "model_metrics": """
  SELECT model_name, 'baseline' AS model_type,
    CASE WHEN scope = 'global' THEN 'global' ELSE 'per_location' END AS training_mode,
    CASE WHEN scope <> 'global' THEN scope END AS location_id, target_variable,
    avg(abs(label - prediction)) AS mae, sqrt(avg(power(label - prediction, 2))) AS rmse,
    sqrt(avg(power(label - prediction, 2))) AS rse,
    avg(CASE WHEN abs(label) > 1e-9 THEN abs((label - prediction) / label) END) * 100 AS mape,
    CASE WHEN var_pop(label) > 0 THEN 1 - avg(power(label - prediction, 2)) / var_pop(label) ELSE 0 END AS r2,
    count(*) AS test_points, 'baseline:/' || model_name || '/' || target_variable || '/' || scope AS model_uri,
    CAST(NULL AS BOOLEAN) AS is_best, TIMESTAMP '2024-01-30 00:00:00' AS created_at
  FROM (SELECT *, 'global' AS scope FROM predictions UNION ALL SELECT *, location_id AS scope FROM predictions)
  WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY model_name, target_variable, scope""",
    "entities": """
  SELECT DISTINCT d.device_id, l.location_id, l.province_id FROM dim_device d JOIN dim_location l ON l.location_id = d.location_id
  UNION ALL
  SELECT 'meteostat_only', location_id, province_id FROM dim_location
  WHERE NOT EXISTS (SELECT 1 FROM dim_device d2 JOIN dim_location l2 ON l2.location_id = d2.location_id)""",
    "bias": f"""
  SELECT device_id, location_id, 'temperature' AS metric_type,
    avg(esp32_temperature_avg - meteostat_temperature) AS bias_value, CAST(count(*) AS INT) AS sample_count
  FROM joined WHERE device_id IS NOT NULL AND hour_ts >= {SQL_AS_OF} - INTERVAL {BIAS_DAYS} DAY
    AND esp32_temperature_avg - meteostat_temperature IS NOT NULL GROUP BY 1, 2
  UNION ALL
  SELECT device_id, location_id, 'humidity', avg(esp32_humidity_avg - meteostat_humidity), CAST(count(*) AS INT)
  FROM joined WHERE device_id IS NOT NULL AND hour_ts >= {SQL_AS_OF} - INTERVAL {BIAS_DAYS} DAY
    AND esp32_humidity_avg - meteostat_humidity IS NOT NULL GROUP BY 1, 2""",
    "long_history": """
  SELECT location_id, device_id, hour_ts, 'temperature' AS metric_type, temperature AS v FROM series
  UNION ALL SELECT location_id, device_id, hour_ts, 'humidity', humidity FROM series""",
    "own_tail": """
  SELECT *, row_number() OVER (PARTITION BY location_id, device_id, metric_type ORDER BY hour_ts DESC, v DESC) AS back,
    count(*) OVER (PARTITION BY location_id, device_id, metric_type) AS total FROM long_history WHERE v IS NOT NULL""",
    "own_line": """
  SELECT location_id, device_id, metric_type, max(total) AS total, least(72, max(total)) AS n72,
    regr_slope(v, CAST(least(72, total) - back AS DOUBLE)) FILTER (back <= 72) AS k,
    regr_intercept(v, CAST(least(72, total) - back AS DOUBLE)) FILTER (back <= 72) AS b
  FROM own_tail GROUP BY 1, 2, 3""",
    "own_fallback": """
  SELECT g.location_id, g.device_id, g.metric_type, g.step AS horizon_step,
    CASE WHEN g.total < 24 THEN last.v WHEN g.total >= 168 THEN s.v ELSE g.b + g.k * (g.n72 + g.step - 1) END AS base_forecast_value,
    CASE WHEN g.total < 24 THEN 'insufficient_data' WHEN g.total >= 168 THEN 'fallback_naive' ELSE 'fallback_trend' END AS model_status
  FROM (SELECT *, CAST(unnest(range(1, 169)) AS INT) AS step FROM own_line) g
  JOIN own_tail last ON last.location_id = g.location_id AND last.device_id = g.device_id
    AND last.metric_type = g.metric_type AND last.back = 1
  LEFT JOIN own_tail s ON s.location_id = g.location_id AND s.device_id = g.device_id
    AND s.metric_type = g.metric_type AND s.back = 168 - (g.step - 1) % 168""",
    "place_tail": """
  SELECT *, row_number() OVER (PARTITION BY location_id, metric_type ORDER BY hour_ts DESC, v DESC) AS back,
    count(*) OVER (PARTITION BY location_id, metric_type) AS total FROM long_history WHERE v IS NOT NULL""",
    "place_line": """
  SELECT location_id, metric_type, max(total) AS total, least(72, max(total)) AS n72,
    regr_slope(v, CAST(least(72, total) - back AS DOUBLE)) FILTER (back <= 72) AS k,
    regr_intercept(v, CAST(least(72, total) - back AS DOUBLE)) FILTER (back <= 72) AS b
  FROM place_tail GROUP BY 1, 2""",
    "place_fallback": """
  SELECT g.location_id, g.metric_type, g.step AS horizon_step,
    CASE WHEN g.total < 24 THEN last.v WHEN g.total >= 168 THEN s.v ELSE g.b + g.k * (g.n72 + g.step - 1) END AS base_forecast_value,
    CASE WHEN g.total < 24 THEN 'insufficient_data' WHEN g.total >= 168 THEN 'fallback_naive' ELSE 'fallback_trend' END AS model_status
  FROM (SELECT *, CAST(unnest(range(1, 169)) AS INT) AS step FROM place_line) g
  JOIN place_tail last ON last.location_id = g.location_id AND last.metric_type = g.metric_type AND last.back = 1
  LEFT JOIN place_tail s ON s.location_id = g.location_id AND s.metric_type = g.metric_type
    AND s.back = 168 - (g.step - 1) % 168""",
    "forecast_rows": f"""
  SELECT e.device_id, e.location_id, e.province_id, p.metric_type, p.horizon_step,
    {SQL_AS_OF} + to_hours(p.horizon_step) AS forecast_timestamp,
    coalesce(o.base_forecast_value, p.base_forecast_value) AS base_forecast_value,
    coalesce(o.model_status, p.model_status) AS model_status,
    coalesce(b.bias_value, 0) AS bias_value, coalesce(b.sample_count, 0) AS sample_count,
    coalesce(o.base_forecast_value, p.base_forecast_value) + coalesce(b.bias_value, 0) AS forecast_value,
    coalesce(o.base_forecast_value, p.base_forecast_value) + coalesce(b.bias_value, 0) AS calibrated_forecast_value,
    'fallback' AS model_name, 'baseline' AS model_type, {SQL_AS_OF} AS generated_at
  FROM entities e JOIN place_fallback p ON p.location_id = e.location_id
  LEFT JOIN own_fallback o ON o.location_id = e.location_id AND o.device_id = e.device_id
    AND o.metric_type = p.metric_type AND o.horizon_step = p.horizon_step
  LEFT JOIN bias b ON b.device_id = e.device_id AND b.location_id = e.location_id AND b.metric_type = p.metric_type""",
    "evaluated": """
  SELECT *, CASE WHEN current_value > max_threshold THEN 'critical' WHEN current_value < min_threshold THEN 'warning' END AS status,
    CASE WHEN current_value > max_threshold THEN max_threshold WHEN current_value < min_threshold THEN min_threshold END AS threshold
  FROM (
    SELECT m.id, m.sensor_id AS source, m.metric_type, m.event_ts, m.metric_value AS current_value, d.id AS device_id,
      coalesce(d.name, m.sensor_id) AS device_name,
      CASE m.metric_type WHEN 'temperature' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'soil_moisture' THEN '%'
        WHEN 'light_intensity' THEN 'lux' WHEN 'pressure' THEN 'hPa' END AS unit,
      CASE WHEN d.device_type = 'temperature_humidity' THEN
        CASE m.metric_type WHEN 'temperature' THEN d.temperature_min_threshold WHEN 'humidity' THEN d.humidity_min_threshold END
      WHEN m.metric_type = 'temperature' AND coalesce(d.temperature_min_threshold, d.temperature_max_threshold) IS NOT NULL THEN d.temperature_min_threshold
      WHEN m.metric_type = 'humidity' AND coalesce(d.humidity_min_threshold, d.humidity_max_threshold) IS NOT NULL THEN d.humidity_min_threshold
      ELSE d.min_threshold END AS min_threshold,
      CASE WHEN d.device_type = 'temperature_humidity' THEN
        CASE m.metric_type WHEN 'temperature' THEN d.temperature_max_threshold WHEN 'humidity' THEN d.humidity_max_threshold END
      WHEN m.metric_type = 'temperature' AND coalesce(d.temperature_min_threshold, d.temperature_max_threshold) IS NOT NULL THEN d.temperature_max_threshold
      WHEN m.metric_type = 'humidity' AND coalesce(d.humidity_min_threshold, d.humidity_max_threshold) IS NOT NULL THEN d.humidity_max_threshold
      ELSE d.max_threshold END AS max_threshold
    FROM metrics m JOIN iot_devices d ON d.source = m.sensor_id WHERE d.is_active AND d.alert_enabled)
  WHERE min_threshold IS NOT NULL AND max_threshold IS NOT NULL""",
    "alert_table": """
  SELECT id, metric_type, status, current_value, threshold, source, CASE WHEN id % 5 <> 0 THEN device_id END AS device_id,
    device_name, unit, min_threshold, max_threshold, 'realtime' AS alert_origin,
    CAST(NULL AS TIMESTAMP) AS forecast_timestamp, CAST(NULL AS TIMESTAMP) AS forecast_generated_at, event_ts AS created_at,
    CASE WHEN id % 3 = 0 THEN date_trunc('second', event_ts) + INTERVAL 1 HOUR END AS resolved_at
  FROM evaluated WHERE status IS NOT NULL""",
    "generic_devices": """
  SELECT s_suppkey AS id, 'sensor_' || s_suppkey AS source, s_suppkey % 10 AS created_by, s_suppkey % 4 <> 1 AS is_active,
    CASE WHEN s_suppkey % 3 = 0 THEN 'n/a' ELSE 'hall ' || s_suppkey END AS location
  FROM supplier""",
    "wide_forecast": """
  SELECT device_id, location_id, forecast_timestamp AS forecast_ts,
    max(CASE WHEN metric_type = 'temperature' THEN coalesce(calibrated_forecast_value, forecast_value) END) AS temperature,
    max(CASE WHEN metric_type = 'humidity' THEN coalesce(calibrated_forecast_value, forecast_value) END) AS humidity,
    max(generated_at) AS generated_at,
    max(CASE WHEN metric_type = 'temperature' THEN model_name END) AS temperature_model_name,
    max(CASE WHEN metric_type = 'humidity' THEN model_name END) AS humidity_model_name,
    max(CASE WHEN metric_type = 'temperature' THEN model_type END) AS temperature_model_type,
    max(CASE WHEN metric_type = 'humidity' THEN model_type END) AS humidity_model_type
  FROM (SELECT *, max(generated_at) OVER (PARTITION BY device_id, location_id, metric_type) AS g FROM forecast_rows)
  WHERE generated_at = g GROUP BY 1, 2, 3""",
    "sensor_forecast": """
  SELECT d.source, f.forecast_ts, f.temperature, f.humidity, f.generated_at
  FROM iot_devices d JOIN wide_forecast f ON f.device_id = 'gw_' || d.c_nationkey""",
    "nearby_stations": """
  SELECT * FROM (
    SELECT l.location_id, s.station_id, s.start_year, s.end_year,
      round(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(s.latitude - l.latitude) / 2), 2)
        + cos(radians(l.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - l.longitude) / 2), 2)))), 6) AS distance_km
    FROM dim_location l, stations s) WHERE distance_km <= 250""",
    "station_obs": """
  SELECT station_id, count(DISTINCT event_ts) AS row_count,
    max(CAST(temperature_c IS NOT NULL AS INT)) + max(CAST(relative_humidity IS NOT NULL AS INT)) AS metric_count
  FROM reference_raw GROUP BY 1""",
    "ranked_stations": """
  SELECT n.*, o.row_count, o.metric_count FROM nearby_stations n LEFT JOIN station_obs o ON o.station_id = n.station_id""",
}
