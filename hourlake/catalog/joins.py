"""Join operators."""

from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import as_of, BIAS_DAYS, SQL_AS_OF
from hourlake.operators import access, alerts, entities, evaluation, forecast, matching, stations
from hourlake.operators.ranking import latest_batch
from hourlake.plans import jobs


@query("j1_join_weather", f"""SELECT location_id, province_id, device_id, hour_ts, {r('esp32_temperature_avg')} AS esp32_temperature_avg,
  {r('esp32_humidity_avg')} AS esp32_humidity_avg, {r('meteostat_temperature')} AS meteostat_temperature,
  {r('meteostat_humidity')} AS meteostat_humidity FROM joined""")
def j1(v):
    return rounded(v.joined)


@query("j2_active_only", """SELECT location_id, event_ts, station_id, l_orderkey, l_linenumber, l_partkey FROM reference_raw
  WHERE province_id IN (SELECT province_id FROM dim_province WHERE coalesce(is_active, true))""")
def j2(v):
    return matching.active_only(v.reference_raw, v.dim_province).select(
        "location_id", "event_ts", "station_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("j3_lookup", """SELECT h.device_id, h.hour_ts, coalesce(p.province_name, 'unknown') AS province_name
  FROM hourly h LEFT JOIN (SELECT province_id, min(province_name) AS province_name FROM dim_province WHERE is_active GROUP BY 1) p
    ON p.province_id = h.province_id""")
def j3(v):
    dim = v.dim_province.where("is_active")
    out = matching.lookup(v.hourly, dim.unionByName(dim), "province_id", ["province_name"])
    return out.select("device_id", "hour_ts", "province_name")


@query("j4_forecast_entities", "SELECT device_id, location_id, province_id FROM entities")
def j4(v):
    return v.entities


@query("j4_forecast_entities_no_device", "SELECT 'meteostat_only' AS device_id, location_id, province_id FROM dim_location")
def j4n(v):
    return matching.forecast_entities(v.dim_device.where(F.col("location_id") == "nowhere"), v.dim_location)


_SENSOR_PLACES = """
  SELECT source AS sensor_id, id, name, CASE id % 3
    WHEN 0 THEN 'Nation_' || c_nationkey || ', Vietnam' WHEN 1 THEN 'NATION_' || c_nationkey || ' (city)' ELSE NULL END AS location,
    CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN 'prov_' || c_nationkey END AS location_province,
    CASE WHEN id % 7 = 0 THEN 'GW_' || c_nationkey ELSE source END AS source FROM iot_devices"""


@query("j5_resolve_entities", f"""
  WITH s AS ({_SENSOR_PLACES}),
  series_keys AS (
    SELECT DISTINCT f.device_id, f.location_id, dl.location_id AS dl_id, dl.location_name, dl.province_id
    FROM entities f LEFT JOIN dim_location dl ON dl.location_id = f.location_id),
  vals AS (SELECT sensor_id, unnest([location, location_province]) AS place FROM s),
  vars AS (
    SELECT DISTINCT sensor_id, lower(trim(x)) AS t FROM (
      SELECT sensor_id, unnest([trim(place), trim(split_part(trim(place), ',', 1)), trim(regexp_replace(place, '\\([^)]*\\)', '', 'g')),
        trim(regexp_replace(place, ',\\s*vietnam\\b', '', 'gi'))]) AS x FROM vals WHERE place IS NOT NULL) WHERE trim(x) <> ''),
  slugs AS (
    SELECT DISTINCT sensor_id, unnest([g, 'loc_' || g, 'loc34_' || g]) AS t FROM (
      SELECT sensor_id, regexp_replace(strip_accents(t), '[^a-z0-9]+', '', 'g') AS g FROM vars) WHERE g <> ''),
  direct AS (SELECT DISTINCT sensor_id, unnest([lower(trim(sensor_id)), CAST(id AS VARCHAR), lower(trim(source)), lower(trim(name))]) AS t FROM s),
  hits AS (
    SELECT v.sensor_id, 0 AS rank, k.device_id, k.location_id FROM vars v JOIN series_keys k
      ON v.t IN (lower(k.location_id), lower(coalesce(k.dl_id, '')), lower(coalesce(k.location_name, '')), lower(coalesce(k.province_id, '')))
    UNION
    SELECT v.sensor_id, 0, k.device_id, k.location_id FROM slugs v JOIN series_keys k
      ON v.t IN (regexp_replace(lower(k.location_id), '[^a-z0-9]', '', 'g'), regexp_replace(lower(coalesce(k.dl_id, '')), '[^a-z0-9]', '', 'g'),
        regexp_replace(lower(coalesce(k.location_name, '')), '[^a-z0-9]', '', 'g'), regexp_replace(lower(coalesce(k.province_id, '')), '[^a-z0-9]', '', 'g'))
    UNION
    SELECT v.sensor_id, 1, k.device_id, k.location_id FROM direct v JOIN series_keys k ON v.t IN (lower(k.device_id), lower(k.location_id)))
  SELECT DISTINCT sensor_id, rank, device_id, location_id FROM hits h
  WHERE rank = (SELECT min(rank) FROM hits b WHERE b.sensor_id = h.sensor_id)""")
def j5(v):
    k, n = F.col("id"), F.col("c_nationkey")
    sensors = v.iot_devices.select(
        F.col("source").alias("sensor_id"), "id", "name",
        F.when(k % 3 == 0, F.concat(F.lit("Nation_"), n, F.lit(", Vietnam")))
        .when(k % 3 == 1, F.concat(F.lit("NATION_"), n, F.lit(" (city)"))).alias("location"),
        F.when((k % 3 == 2) & (k % 2 == 0), F.concat(F.lit("prov_"), n)).alias("location_province"),
        F.when(k % 7 == 0, F.concat(F.lit("GW_"), n)).otherwise(F.col("source")).alias("source"))
    return entities.resolve_entities(sensors, v.entities, v.dim_location)


@query("j6_latest_batch", f"""
  WITH b AS (SELECT device_id, location_id, metric_type, horizon_step, forecast_value,
      generated_at - to_hours(CAST(horizon_step % 2 AS INT)) AS generated_at FROM forecast_rows)
  SELECT device_id, metric_type, horizon_step, {r('forecast_value')} AS forecast_value, generated_at FROM b
  WHERE generated_at = (SELECT max(generated_at) FROM b c WHERE c.metric_type = b.metric_type)""")
def j6(v):
    f = v.forecast_table.withColumn(
        "generated_at", F.timestamp_seconds(F.unix_seconds("generated_at") - (F.col("horizon_step") % 2) * 3600))
    out = latest_batch(f, ["metric_type"], "generated_at")
    return rounded(out.select("device_id", "metric_type", "horizon_step", "forecast_value", "generated_at"))


_BOARD = """board AS (
    SELECT m.*, coalesce(is_best, row_number() OVER (PARTITION BY target_variable ORDER BY round(rmse, 9) NULLS LAST, round(mae, 9) NULLS LAST,
      round(r2, 9) DESC NULLS LAST, created_at DESC NULLS LAST, model_name, model_type, model_uri) = 1) AS best FROM model_metrics m)"""


def steady(df):
    """Scores rounded to 9 digits, so that ranks do not hang on summation order."""
    return df.withColumns({c: F.round(c, 9) for c in ("rmse", "mae", "r2", "rse", "mape")})


_ORD = """target_variable, best DESC NULLS LAST, round(rmse, 9) NULLS LAST, round(mae, 9) NULLS LAST, created_at DESC NULLS LAST,
  model_name, model_type, model_uri, location_id NULLS FIRST"""


@query("j7_leaderboard_for", f"""
  WITH {_BOARD}, lb AS (SELECT b.*, l.province_id AS province FROM board b LEFT JOIN dim_location l ON l.location_id = b.location_id),
  s AS (SELECT d.source AS sensor_id, d.id, l.location_id AS place, l.province_id AS own_province FROM iot_devices d JOIN dim_location l ON l.n_nationkey = d.c_nationkey),
  direct AS (SELECT * FROM (SELECT sensor_id, 0 AS origin, lb.*, row_number() OVER (PARTITION BY sensor_id ORDER BY {_ORD}) AS rn
    FROM s JOIN lb ON lb.location_id = s.place AND lb.target_variable = 'humidity' WHERE s.id % 10 = 0) WHERE rn <= 8),
  near AS (SELECT * FROM (SELECT sensor_id, 1 AS origin, lb.*, row_number() OVER (PARTITION BY sensor_id ORDER BY {_ORD}) AS rn
    FROM s JOIN lb ON lb.location_id = s.place OR lb.province = s.own_province WHERE sensor_id NOT IN (SELECT sensor_id FROM direct)) WHERE rn <= 8),
  worldwide AS (SELECT *, row_number() OVER (ORDER BY {_ORD}) AS rn FROM lb WHERE coalesce(training_mode, 'global') = 'global'),
  both_parts AS (SELECT * FROM direct UNION ALL SELECT * FROM near
    UNION ALL SELECT n.sensor_id, 2, g.* FROM (SELECT sensor_id, count(*) AS n FROM near GROUP BY 1) n JOIN worldwide g ON g.rn <= 8 - n.n)
  SELECT sensor_id, origin, target_variable, model_name, training_mode, location_id, {r('round(rmse, 9)')} AS rmse, best AS is_best FROM (
    SELECT *, row_number() OVER (PARTITION BY sensor_id, target_variable, model_name, training_mode, location_id, created_at ORDER BY origin, rn) AS k FROM both_parts) WHERE k = 1""")
def j7(v):
    """Every tenth sensor has evaluation rows of its own (those of its place for humidity)."""
    board = evaluation.leaderboard(steady(v.model_table)).drop("rank_order")
    l = v.dim_location.select("location_id", "province_id", "n_nationkey")
    e = v.iot_devices.join(l, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "id", F.col("source").alias("sensor_id"), "location_id", "province_id")
    direct = e.where("id % 10 = 0").select("sensor_id", "location_id").join(board.where("target_variable = 'humidity'"), "location_id")
    out = evaluation.leaderboard_for(e, board, v.dim_location, 8, direct)
    return rounded(out.select("sensor_id", "origin", "target_variable", "model_name", "training_mode", "location_id", "rmse", "is_best"))


@query("j8_nearby_stations", "SELECT location_id, station_id, distance_km FROM ranked_stations")
def j8n(v):
    return jobs.station_candidates(v).select("location_id", "station_id", "distance_km")


_CHOSEN = """acc AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY distance_km, row_count DESC, metric_count DESC, station_id) AS rn
    FROM ranked_stations WHERE coalesce(start_year, 2024) <= 2024 AND coalesce(end_year, 2024) >= 2024 AND distance_km <= 200
      AND row_count > 0 AND row_count / 720.0 >= 0.5),
  pts AS (SELECT location_id, count(DISTINCT event_ts) AS point_rows FROM reference_raw WHERE l_linenumber = 1 GROUP BY 1),
  pick AS (
    SELECT l.location_id, coalesce(p.point_rows, 0) AS n, a.station_id AS sid, a.distance_km AS dk, a.row_count AS rc,
      CASE WHEN coalesce(p.point_rows, 0) / 720.0 >= 0.5 THEN 'point' WHEN a.station_id IS NOT NULL THEN 'station'
        WHEN coalesce(p.point_rows, 0) > 0 THEN 'partial_point' END AS fetch_method
    FROM dim_location l LEFT JOIN pts p ON p.location_id = l.location_id LEFT JOIN acc a ON a.location_id = l.location_id AND a.rn = 1)"""


@query("j8_select_station", f"""
  WITH {_CHOSEN}
  SELECT location_id, fetch_method, CASE WHEN fetch_method = 'station' THEN sid END AS station_id,
    CASE WHEN fetch_method = 'station' THEN dk END AS distance_km, CASE WHEN fetch_method = 'station' THEN rc ELSE n END AS row_count,
    {r("CASE WHEN fetch_method = 'station' THEN rc ELSE n END / CAST(720 AS DOUBLE)")} AS coverage_ratio,
    CASE WHEN fetch_method = 'station' THEN CASE WHEN dk <= 75 THEN 'near_station' WHEN dk <= 150 THEN 'medium_distance_station'
      WHEN dk <= 200 THEN 'far_station' ELSE 'too_far_station' END ELSE 'point' END AS data_quality
  FROM pick""")
def j8(v):
    return rounded(_chosen(v))


def _chosen(v):
    points = v.reference_raw.where("l_linenumber = 1").groupBy("location_id").agg(
        F.count_distinct("event_ts").alias("point_rows"))
    return stations.select_station(v.dim_location, jobs.station_candidates(v), points, jobs.EXPECTED, jobs.MIN_COVERAGE)


@query("w16_flag_primary", f"""
  WITH {_CHOSEN}
  SELECT s.location_id, s.station_id, coalesce(s.station_id = CASE WHEN p.fetch_method = 'station' THEN p.sid END, false) AS is_primary
  FROM ranked_stations s LEFT JOIN pick p ON p.location_id = s.location_id""")
def w16(v):
    return stations.flag_primary(jobs.station_candidates(v), _chosen(v)).select("location_id", "station_id", "is_primary")


@query("j9_nearest_obs", f"""
  WITH a AS (SELECT t.id, t.created_at, l.location_id FROM alert_table t JOIN iot_devices d ON d.source = t.source
      JOIN dim_location l ON l.n_nationkey = d.c_nationkey)
  SELECT id, obs_ts, {r('temperature_c')} AS temperature_c FROM (
    SELECT a.id, o.event_ts AS obs_ts, o.temperature_c, row_number() OVER (PARTITION BY a.id
      ORDER BY abs(epoch_us(a.created_at) - epoch_us(o.event_ts)), o.event_ts) AS rn
    FROM a LEFT JOIN reference o ON o.location_id = a.location_id AND CAST(o.event_ts AS DATE) = CAST(a.created_at AS DATE)) WHERE rn = 1""")
def j9(v):
    d = v.iot_devices.join(v.dim_location, F.col("c_nationkey") == F.col("n_nationkey")).select("source", "location_id")
    a = v.alert_table.join(d, "source").select("id", "created_at", "location_id")
    out = matching.nearest_obs(a, v.reference, ["location_id"], values=["temperature_c"])
    return rounded(out.select("id", "obs_ts", "temperature_c"))


@query("j10_device_counts", """SELECT u.user_id, count(d.id) AS device_count FROM (SELECT user_id FROM users UNION ALL SELECT 10) u
  LEFT JOIN iot_devices d ON d.user_id = u.user_id GROUP BY 1""")
def j10(v):
    users = v.users.select("user_id").unionByName(v.users.where("is_admin").select((F.col("user_id") + 10).alias("user_id")))
    return access.device_counts(users, v.iot_devices).select("user_id", "device_count")


_ACCESS = """acc AS (
    SELECT 'admin' AS viewer, source FROM iot_devices WHERE is_active UNION SELECT 'admin', source FROM generic_devices WHERE is_active
    UNION SELECT 'admin', sensor_id FROM metrics WHERE sensor_id <> ''
    UNION SELECT 'public', 'system_monitor'
    UNION SELECT 'user:' || created_by, source FROM generic_devices WHERE created_by IN (SELECT user_id FROM users WHERE NOT is_admin)
    UNION SELECT 'user:' || user_id, source FROM iot_devices WHERE user_id IN (SELECT user_id FROM users WHERE NOT is_admin))"""


def _access(v):
    return access.accessible_sources(v.users, v.iot_devices, v.generic_devices, v.metrics)


@query("j11_accessible_sources", f"WITH {_ACCESS} SELECT viewer, source FROM acc")
def j11(v):
    return _access(v)


@query("j11_permitted_devices", """SELECT DISTINCT o.o_custkey % 10 AS user_id, g.id AS device_id, g.source FROM orders o
  JOIN generic_devices g ON g.id = o.o_orderkey % 50 WHERE g.is_active""")
def j11p(v):
    perms = v.read("orders").select((F.col("o_custkey") % 10).alias("user_id"), (F.col("o_orderkey") % 50).alias("device_id"))
    return access.permitted_devices(perms, v.generic_devices)


@query("j12_visible_alerts", f"""WITH {_ACCESS}
  SELECT 'user:' || d.user_id AS viewer, a.id FROM alert_table a JOIN iot_devices d ON d.id = a.device_id
  UNION ALL SELECT acc.viewer, a.id FROM alert_table a JOIN acc ON acc.source = a.source WHERE a.device_id IS NULL AND viewer <> 'admin'
  UNION ALL SELECT 'admin', id FROM alert_table""")
def j12(v):
    return access.visible_alerts(v.alert_table, v.iot_devices, _access(v))


_DEVS2 = """devs AS (
    SELECT * FROM iot_devices UNION ALL
    SELECT * REPLACE (id + 100000 AS id, 'humidity' AS device_type, 9.0::DOUBLE AS min_threshold) FROM iot_devices WHERE device_type = 'temperature')"""


def _devices2(v):
    """Sources with two device rows, so that the exact-type rule matters."""
    extra = v.iot_devices.where("device_type = 'temperature'").withColumns(
        {"id": F.col("id") + 100000, "device_type": F.lit("humidity"), "min_threshold": F.lit(9.0)})
    return v.iot_devices.unionByName(extra)


@query("j13_attach_thresholds", f"""WITH {_DEVS2}
  SELECT id, device_id, min_threshold FROM (
    SELECT m.id, d.id AS device_id, d.min_threshold, row_number() OVER (PARTITION BY m.id
      ORDER BY CASE WHEN d.device_type = m.metric_type THEN 0 ELSE 1 END, d.id) AS rn
    FROM metrics m JOIN devs d ON d.source = m.sensor_id) WHERE rn = 1""")
def j13(v):
    return matching.attach_thresholds(v.metrics, _devices2(v)).select("id", "device_id", "min_threshold")


_BREACH = f"""tgt AS (SELECT * FROM iot_devices WHERE is_active AND alert_enabled AND coalesce(temperature_min_threshold,
      temperature_max_threshold, humidity_min_threshold, humidity_max_threshold) IS NOT NULL),
  checks AS (
    SELECT f.source, t.id AS device_id, f.forecast_ts, f.generated_at, c.* FROM sensor_forecast f JOIN tgt t ON t.source = f.source,
      LATERAL (VALUES
        ('temperature', 'high', 'critical', f.temperature, t.temperature_max_threshold, f.temperature > t.temperature_max_threshold),
        ('temperature', 'low', 'warning', f.temperature, t.temperature_min_threshold, f.temperature < t.temperature_min_threshold),
        ('humidity', 'high', 'critical', f.humidity, t.humidity_max_threshold, f.humidity > t.humidity_max_threshold),
        ('humidity', 'low', 'warning', f.humidity, t.humidity_min_threshold, f.humidity < t.humidity_min_threshold)
      ) c(metric_type, direction, status, current_value, threshold, hit)
    WHERE f.forecast_ts > {SQL_AS_OF} AND f.forecast_ts <= {SQL_AS_OF} + INTERVAL 24 HOUR),
  breaches AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, metric_type, direction ORDER BY forecast_ts, current_value) AS rn
      FROM checks WHERE hit) WHERE rn = 1),
  raised AS (SELECT source, metric_type, status, threshold, forecast_ts FROM breaches WHERE CAST(substr(source, 8) AS INT) % 3 = 0),
  fresh AS (SELECT b.* FROM breaches b WHERE NOT EXISTS (SELECT 1 FROM raised e WHERE e.source = b.source AND e.metric_type = b.metric_type
      AND e.status = b.status AND e.threshold = b.threshold AND e.forecast_ts = b.forecast_ts))"""


def _breaches(v):
    return alerts.first_breaches(v.sensor_forecast, alerts.forecast_devices(v.iot_devices), as_of())


def _existing(v):
    """Alerts raised by an earlier scan: those of every third device, a day ago; the others three days ago."""
    third = F.substring("source", 8, 20).cast("int") % 3 == 0
    ago = F.unix_seconds(as_of()) - F.when(third, 86_400).otherwise(3 * 86_400)
    return _breaches(v).withColumns({"alert_origin": F.lit("forecast"), "created_at": F.timestamp_seconds(ago)})


@query("j14_new_alerts", f"""WITH {_BREACH} SELECT source, metric_type, direction, forecast_ts AS forecast_timestamp,
  {r('current_value')} AS current_value FROM fresh""")
def j14(v):
    out = alerts.new_alerts(_breaches(v), _existing(v), as_of())
    return rounded(out.select("source", "metric_type", "direction", "forecast_timestamp", "current_value"))


@query("w11_first_breaches", f"""WITH {_BREACH} SELECT source, device_id, metric_type, direction, status, threshold,
  forecast_ts AS forecast_timestamp, {r('current_value')} AS current_value FROM breaches""")
def w11(v):
    return rounded(_breaches(v).select(
        "source", "device_id", "metric_type", "direction", "status", "threshold", "forecast_timestamp", "current_value"))


_REPORT = f"""WITH {_BREACH}
  SELECT t.source, coalesce(s.n, 0) AS forecast_rows, coalesce(s.w, 0) AS rows_in_window, s.a AS first_forecast_ts, s.z AS last_forecast_ts,
    coalesce(b.n, 0) AS breaches, coalesce(c.n, 0) AS created, coalesce(b.n, 0) - coalesce(c.n, 0) AS duplicates
  FROM tgt t LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (forecast_ts > {SQL_AS_OF} AND forecast_ts <= {SQL_AS_OF} + INTERVAL 24 HOUR) AS w,
      min(forecast_ts) AS a, max(forecast_ts) AS z FROM sensor_forecast GROUP BY 1) s ON s.source = t.source
  LEFT JOIN (SELECT source, count(*) AS n FROM breaches GROUP BY 1) b ON b.source = t.source
  LEFT JOIN (SELECT source, count(*) AS n FROM fresh GROUP BY 1) c ON c.source = t.source"""


@query("x10_forecast_scan", f"""WITH {_BREACH} SELECT source, device_id, metric_type, status, threshold FROM fresh""")
def x10(v):
    created, _ = jobs.forecast_scan(v.sensor_forecast, v.iot_devices, _existing(v), as_of())
    return created.select("source", "device_id", "metric_type", "status", "threshold")


@query("a23_scan_report", _REPORT)
def a23(v):
    return jobs.forecast_scan(v.sensor_forecast, v.iot_devices, _existing(v), as_of())[1]


@query("j15_enrich_readings", """
  SELECT x.id, x.device_id, x.source_type, x.environment_type, x.temperature_unit,
    coalesce(CASE WHEN lower(trim(x.d_location)) NOT IN ('', 'unknown', 'n/a', 'na', 'null', 'none') THEN trim(x.d_location) END,
      CASE WHEN lower(trim(x.g_location)) NOT IN ('', 'unknown', 'n/a', 'na', 'null', 'none') THEN trim(x.g_location) END,
      CASE WHEN lower(trim(x.location)) NOT IN ('', 'unknown', 'n/a', 'na', 'null', 'none') THEN trim(x.location) END) AS location
  FROM (SELECT rd.id, d.id AS device_id, CASE WHEN rd.id % 4 = 0 THEN 'payload_type' ELSE coalesce(d.c_mktsegment, 'physical_iot') END AS source_type,
      CASE WHEN d.id % 2 = 0 THEN 'outdoor' ELSE 'indoor' END AS environment_type, CASE WHEN rd.id % 6 = 0 THEN 'F' ELSE 'C' END AS temperature_unit,
      CASE WHEN d.id % 3 = 0 THEN 'Unknown' WHEN d.id % 3 = 1 THEN d.name END AS d_location, g.location AS g_location,
      CASE WHEN rd.id % 5 = 0 THEN ' n/a ' ELSE 'message place' END AS location
    FROM readings rd LEFT JOIN iot_devices d ON d.source = rd.sensor_id LEFT JOIN generic_devices g ON g.source = rd.sensor_id) x""")
def j15(v):
    k = F.col("id")
    no = lambda t: F.lit(None).cast(t)
    rd = v.readings.withColumns({
        "source_type": F.when(k % 4 == 0, "payload_type"), "environment_type": no("string"),
        "location": F.when(k % 5 == 0, " n/a ").otherwise("message place"), "location_province": no("string"),
        "latitude": no("double"), "longitude": no("double"),
        "temperature_unit": F.when(k % 6 == 0, "F"), "humidity_unit": no("string")})
    dev = v.iot_devices.withColumns({
        "source_type": F.col("c_mktsegment"), "environment_type": F.when(k % 2 == 0, "outdoor"),
        "location": F.when(k % 3 == 0, "Unknown").when(k % 3 == 1, F.col("name")),
        "location_province": no("string"), "latitude": no("double"), "longitude": no("double")})
    out = matching.enrich_readings(rd, dev, v.generic_devices)
    return out.select("id", "device_id", "source_type", "environment_type", "temperature_unit", "location")


@query("j16_calibrate", f"""SELECT device_id, metric_type, horizon_step, {r('base_forecast_value')} AS base_forecast_value,
  {r('bias_value')} AS bias_value, sample_count, {r('calibrated_forecast_value')} AS calibrated_forecast_value FROM forecast_rows""")
def j16(v):
    return rounded(v.forecast_rows.select(
        "device_id", "metric_type", "horizon_step", "base_forecast_value", "bias_value", "sample_count", "calibrated_forecast_value"))


@query("j17_forecast_grid", f"""SELECT device_id, location_id, m.metric_type, CAST(s.step AS INT) AS horizon_step,
  {SQL_AS_OF} + to_hours(CAST(s.step AS INT)) AS forecast_timestamp FROM entities, (VALUES ('temperature'), ('humidity')) m(metric_type), range(1, 169) s(step)""")
def j17(v):
    return forecast.forecast_grid(v.entities, 168, as_of()).select(
        "device_id", "location_id", "metric_type", "horizon_step", "forecast_timestamp")


@query("m12_calibration_profile", f"""SELECT e.device_id, e.location_id, m.metric_type, {r('coalesce(b.bias_value, 0)')} AS bias_value,
  coalesce(b.sample_count, 0) AS sample_count, {BIAS_DAYS} AS window_days, {SQL_AS_OF} AS updated_at
  FROM entities e CROSS JOIN (VALUES ('temperature'), ('humidity')) m(metric_type)
  LEFT JOIN bias b ON b.device_id = e.device_id AND b.location_id = e.location_id AND b.metric_type = m.metric_type""")
def m12(v):
    bias = forecast.recent_bias(v.joined, BIAS_DAYS, as_of())
    return rounded(forecast.calibration_profile(v.entities, bias, BIAS_DAYS, as_of()))


@query("x12_notification_targets", """
  WITH owners AS (SELECT user_id, user_id % 2 = 0 AS telegram_enabled, 'chat' || user_id AS telegram_chat_id, user_id % 3 <> 0 AS email_enabled,
      CASE WHEN user_id % 4 = 0 THEN 'note' || user_id END AS notification_email, 'mail' || user_id AS email FROM users),
  targets AS (SELECT DISTINCT o_custkey % 10 AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'telegram' ELSE 'email' END AS channel,
      'addr' || (o_orderkey % 5) AS address, o_orderkey % 5 <> 0 AND (o_custkey % 10) % 3 = 1 AS is_enabled FROM orders),
  a AS (SELECT t.id AS alert_id, d.user_id FROM alert_table t JOIN iot_devices d ON d.source = t.source),
  legacy AS (SELECT user_id, 'telegram' AS channel, telegram_chat_id AS address FROM owners WHERE telegram_enabled
    UNION ALL SELECT user_id, 'email', coalesce(notification_email, email) FROM owners WHERE email_enabled)
  SELECT a.alert_id, a.user_id, t.channel, t.address FROM a JOIN targets t ON t.user_id = a.user_id AND t.is_enabled
  UNION ALL
  SELECT a.alert_id, a.user_id, l.channel, l.address FROM a JOIN legacy l ON l.user_id = a.user_id
  WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.user_id = a.user_id AND t.channel = l.channel AND t.is_enabled)""")
def x12(v):
    u = F.col("user_id")
    owners = v.users.select(
        "user_id", (u % 2 == 0).alias("telegram_enabled"), F.concat(F.lit("chat"), u).alias("telegram_chat_id"),
        (u % 3 != 0).alias("email_enabled"), F.when(u % 4 == 0, F.concat(F.lit("note"), u)).alias("notification_email"),
        F.concat(F.lit("mail"), u).alias("email"))
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 10
    targets = v.read("orders").select(
        c.alias("user_id"), F.when(k % 2 == 0, "telegram").otherwise("email").alias("target_type"),
        F.concat(F.lit("addr"), k % 5).alias("target_value"), ((k % 5 != 0) & (c % 3 == 1)).alias("is_enabled")).distinct()
    return matching.notification_targets(v.alert_table, v.iot_devices, owners, targets)
