"""Scalar functions over whole columns of the given tables."""

from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import as_of, SQL_AS_OF
from hourlake.functions import geo, measure, messages, models, text, when


@query("f1_calendar", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month FROM events")
def f1(v):
    return v.events.select("event_id", *when.calendar("ts"))


@query("f2_cyclic", f"""SELECT event_id, {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos,
  {r('sin(2 * pi() * (dayofweek(ts) + 1) / 7)')} AS day_of_week_sin, {r('cos(2 * pi() * (dayofweek(ts) + 1) / 7)')} AS day_of_week_cos FROM events""")
def f2(v):
    e = v.events.select("event_id", *when.calendar("ts"))
    return rounded(e.select("event_id", *when.cyclic("hour", 24), *when.cyclic("day_of_week", 7)))


@query("f3_hour_floor", "SELECT event_id, date_trunc('hour', ts) AS hour_ts, date_trunc('minute', ts) AS minute_ts FROM events")
def f3(v):
    return v.events.select("event_id", when.hour_floor("ts").alias("hour_ts"), when.minute_key("ts").alias("minute_ts"))


@query("f4_parse_epoch_or_iso", """
  SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 1 THEN date_trunc('millisecond', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 7 HOUR
      ELSE date_trunc('second', ts) END AS parsed,
    CASE event_id % 6 WHEN 5 THEN NULL WHEN 1 THEN epoch_us(ts) // 1000 WHEN 4 THEN (epoch_us(ts) // 1000000 - 25200) * 1000 ELSE epoch_us(ts) // 1000000 * 1000 END AS parsed_ms
  FROM events""")
def f4(v):
    k, ts = F.col("event_id") % 6, F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, F.unix_millis(ts).cast("string"))
           .when(k == 2, F.concat(iso, F.lit("Z"))).when(k == 3, iso).when(k == 4, F.concat(iso, F.lit("+07:00"))).otherwise("garbage"))
    parsed, ms = when.parse_epoch_or_iso(raw)
    return v.events.select("event_id", parsed.alias("parsed"), ms.alias("parsed_ms"))


@query("f5_to_local", f"""
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 7 HOUR WHEN 1 THEN date_trunc('second', ts)
    WHEN 2 THEN date_trunc('second', ts) + INTERVAL 5 HOUR ELSE {SQL_AS_OF} END AS local_ts FROM events""")
def f5(v):
    k, iso = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise("soon")
    return v.events.select("event_id", when.to_local(raw, as_of()).alias("local_ts"))


@query("f6_clean_float", f"""SELECT event_id, {r("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")} AS cleaned,
  {r("CASE WHEN event_id % 7 = 0 THEN NULL ELSE round((value - 32) * 5 / 9, 2) END")} AS celsius FROM events""")
def f6(v):
    raw = F.when(F.col("event_id") % 14 == 0, "nan").when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value")))
    return rounded(v.events.select("event_id", measure.clean_float(raw).alias("cleaned"), measure.f_to_c(raw).alias("celsius")))


@query("f7_rh_from_dewpoint", f"""SELECT event_id, round(greatest(0, least(100, 100 * exp(17.625::DOUBLE * d / (243.04::DOUBLE + d)) / exp(17.625::DOUBLE * t / (243.04::DOUBLE + t)))), 1) AS rh
  FROM (SELECT event_id, value / 4 AS t, value / 4 - (event_id % 12) AS d FROM events)""")
def f7(v):
    t = F.col("value") / 4.0
    return v.events.select("event_id", measure.rh_from_dewpoint(t, t - F.col("event_id") % 12).alias("rh"))


_HAV = """2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(s.latitude - l.latitude) / 2), 2)
  + cos(radians(l.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - l.longitude) / 2), 2))))"""


@query("f8_haversine", f"""SELECT s.station_id, {r(_HAV)} AS km, {r(f'CASE WHEN {_HAV} * 10 > 1000 THEN {_HAV} / 100 ELSE {_HAV} * 10 END')} AS fixed
  FROM stations s JOIN dim_location l ON l.n_nationkey = s.s_nationkey""")
def f8(v):
    l = v.dim_location.select(F.col("latitude").alias("la"), F.col("longitude").alias("lo"), "n_nationkey")
    d = geo.haversine_km(F.col("la"), F.col("lo"), F.col("latitude"), F.col("longitude"))
    j = v.stations.join(l, F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(j.select("station_id", d.alias("km"), geo.metres_fix(d * 10.0).alias("fixed")))


@query("f9_distance_bucket", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'point' WHEN value <= 75 THEN 'near_station' WHEN value <= 150 THEN 'medium_distance_station'
  WHEN value <= 200 THEN 'far_station' ELSE 'too_far_station' END AS bucket FROM events""")
def f9(v):
    method = F.when(F.col("event_id") % 10 == 0, "point").otherwise("station")
    return v.events.select("event_id", geo.distance_bucket(F.col("value"), method).alias("bucket"))


@query("f10_first_present", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN event_type ELSE NULL END AS picked FROM events""")
def f10(v):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.col("props")).when(k == 1, "").when(k == 2, "null")
    b = F.when(k < 3, F.col("event_type"))
    return v.events.select("event_id", text.first_present(a, b).alias("picked"))


@query("f11_strip_accents", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def f11(v):
    return v.read("documents").select("doc_id", text.strip_accents(F.col("text")).alias("folded"))


@query("f11_slug", "SELECT doc_id, regexp_replace(strip_accents(lower(trim(text))), '[^a-z0-9]+', '', 'g') AS slug FROM documents")
def f11s(v):
    return v.read("documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


_PLACE = "' ' || n_name || CASE n_nationkey % 3 WHEN 0 THEN ' (city), Vietnam' WHEN 1 THEN ', North' ELSE '' END"
_RAW = f"(SELECT n_nationkey, trim({_PLACE}) AS raw FROM nation)"
_FORMS = f"""(SELECT DISTINCT n_nationkey, lower(trim(x)) AS t FROM (SELECT n_nationkey, unnest([raw, trim(split_part(raw, ',', 1)),
  trim(regexp_replace(raw, '\\([^)]*\\)', '', 'g')), trim(regexp_replace(raw, ',\\s*vietnam\\b', '', 'gi'))]) AS x FROM {_RAW}) WHERE trim(x) <> '')"""


def _place():
    k = F.col("n_nationkey") % 3
    return F.concat(F.lit(" "), F.col("n_name"), F.when(k == 0, " (city), Vietnam").when(k == 1, ", North").otherwise(""))


@query("f12_text_variants", f"SELECT n_nationkey, t AS variant FROM {_FORMS}")
def f12(v):
    return v.read("nation").select("n_nationkey", F.explode(text.text_variants(_place())).alias("variant"))


@query("f12_slug_variants", f"""SELECT DISTINCT n_nationkey, unnest([g, 'loc_' || g, 'loc34_' || g]) AS variant
  FROM (SELECT n_nationkey, regexp_replace(t, '[^a-z0-9]+', '', 'g') AS g FROM {_FORMS})""")
def f12s(v):
    return v.read("nation").select("n_nationkey", F.explode(text.slug_variants(_place())).alias("variant"))


@query("f13_norm_sensor_id", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'esp' || user_id ELSE 'sensor_' || user_id END AS sensor_id FROM events""")
def f13(v):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = (F.when(k == 0, F.concat(F.lit("Sensor-00"), u)).when(k == 1, F.concat(F.lit("sensor"), u))
           .when(k == 2, F.concat(F.lit(" SENSOR_"), u)).otherwise(F.concat(F.lit(" ESP"), u, F.lit(" "))))
    return v.events.select("event_id", text.norm_sensor_id(raw).alias("sensor_id"))


@query("f14_normalise_labels", """SELECT id, CASE WHEN id % 3 = 0 THEN 'outdoor' ELSE 'indoor' END AS environment,
  CASE metric_type WHEN 'temperature' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'soil_moisture' THEN '%' WHEN 'light_intensity' THEN 'lux' WHEN 'pressure' THEN 'hPa' END AS unit,
  CASE WHEN id % 4 = 0 THEN NULL ELSE sensor_id END AS place FROM metrics""")
def f14(v):
    k = F.col("id")
    env = F.when(k % 6 == 0, " Outdoor ").when(k % 3 == 0, "Ngoài trời").when(k % 3 == 1, "hall").otherwise(F.lit(None))
    place = F.when(k % 8 == 0, " N/A ").when(k % 4 == 0, "unknown").otherwise(F.concat(F.col("sensor_id"), F.lit(" ")))
    return v.metrics.select("id", text.norm_env(env).alias("environment"), measure.default_unit(F.upper("metric_type")).alias("unit"),
                            text.null_placeholder(place).alias("place"))


@query("f15_quality_label", """SELECT model_uri, CASE WHEN r2 >= 0.85 THEN 'excellent' WHEN r2 >= 0.65 THEN 'good' WHEN r2 >= 0.35 OR rmse IS NOT NULL THEN 'usable' ELSE 'weak' END AS quality_label,
  CASE WHEN r2 >= 0.85 THEN 0.95::DOUBLE WHEN r2 >= 0.65 THEN 0.8 WHEN r2 >= 0.35 OR rmse IS NOT NULL THEN 0.6 ELSE 0.35 END AS confidence_score FROM model_metrics""")
def f15(v):
    return v.model_metrics.select("model_uri", models.quality_label(F.col("r2"), F.col("rmse")).alias("q")).select("model_uri", "q.*")


@query("f16_model_status", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'trained_spark_gbt' WHEN 1 THEN 'trained_random_forest' WHEN 2 THEN 'trained_deep_learning'
  WHEN 3 THEN 'fallback_naive' ELSE 'trained_lstm' END AS status, CASE WHEN p_size % 3 = 0 THEN 'global' WHEN p_size % 3 = 1 THEN p_brand ELSE 'fallback' END AS scope FROM part""")
def f16(v):
    k, s = F.col("p_partkey") % 5, F.col("p_size") % 3
    name = F.when(k == 0, "Spark GBT").when(k == 1, "Spark Random Forest").when(k == 2, "CNN-LSTM").when(k == 3, "last value").otherwise("LSTM")
    kind = F.when(k < 2, "spark_mllib").when(k == 3, "baseline").otherwise("deep_learning")
    mode = F.when(s == 0, "global").when(s == 1, "per_location")
    return v.read("part").select("p_partkey", models.model_status(name, kind).alias("status"),
                                 models.model_scope(mode, F.lit(None).cast("string"), F.col("p_brand")).alias("scope"))


@query("f17_age_minutes", f"SELECT event_id, round(greatest(0, (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 60000000.0::DOUBLE), 1) AS age_minutes FROM events")
def f17(v):
    return v.events.select("event_id", when.age_minutes("ts", as_of()).alias("age_minutes"))


@query("f18_ratios", f"""SELECT hour_ts, device_id, {r('missing_ratio')} AS missing_ratio,
  CAST(date_diff('day', make_date(year(hour_ts), 1, 1), make_date(year(hour_ts) + 1, 1, 1)) * 24 + 1 AS INT) AS expected_hours,
  {r('record_count / CAST(720 AS DOUBLE)')} AS coverage FROM hourly""")
def f18(v):
    h = v.hourly
    return rounded(h.select("hour_ts", "device_id", measure.missing_ratio(F.col("record_count")).alias("missing_ratio"),
                            when.expected_hours(F.year("hour_ts")).alias("expected_hours"),
                            measure.coverage_ratio(F.col("record_count"), F.lit(720)).alias("coverage")))


@query("f19_sensor_from_topic", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sensor_' || user_id ELSE 'nobody' END AS sensor_id FROM events")
def f19(v):
    k, u = F.col("event_id") % 3, F.col("user_id")
    topic = F.when(k == 0, F.concat(F.lit("sensors/sensor_"), u, F.lit("/data"))).when(k == 1, F.concat(F.lit("sensors/"), u)).otherwise("other/a/b")
    return v.events.select("event_id", text.sensor_from_topic(topic, "nobody").alias("sensor_id"))


@query("f20_alert_text", """
  SELECT id, 'IoT Alert' || chr(10) || 'Device: ' || device_name || chr(10) || 'Source: ' || source || chr(10) || 'Metric: ' || label || chr(10)
    || 'Current value: ' || printf('%.2f', current_value) || ' ' || unit || chr(10)
    || 'Threshold trigger: ' || CASE WHEN status = 'critical' THEN '> ' ELSE '< ' END || printf('%.2f', threshold) || ' ' || unit || chr(10)
    || 'Allowed range: ' || printf('%.2f', min_threshold) || ' ' || unit || ' - ' || printf('%.2f', max_threshold) || ' ' || unit || chr(10)
    || 'Status: ' || upper(status) || chr(10) || 'Time: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') AS body,
    '[Alert] ' || label || ' out of range on ' || device_name AS subject
  FROM (SELECT *, CASE metric_type WHEN 'temperature' THEN 'Temperature' WHEN 'humidity' THEN 'Humidity' WHEN 'soil_moisture' THEN 'Soil moisture'
    WHEN 'light_intensity' THEN 'Light intensity' ELSE 'Pressure' END AS label FROM alert_table)""")
def f20(v):
    return v.alert_table.select("id", messages.alert_text().alias("body"), messages.alert_subject().alias("subject"))


@query("f21_pick_by_keyword", """SELECT s_nationkey, station_id FROM (SELECT s_nationkey, station_id, row_number() OVER (PARTITION BY s_nationkey
  ORDER BY CASE WHEN contains(lower(station_name), '7') OR contains(lower(station_name), 'hue') THEN 0 ELSE 1 END, station_id) AS rn FROM stations) WHERE rn = 1""")
def f21(v):
    from hourlake.operators.ranking import keep_first

    hit = text.keyword_hit(F.col("station_name"), ["7", "Huế", " "])
    return keep_first(v.stations, ["s_nationkey"], [hit.desc(), F.col("station_id").asc()]).select("s_nationkey", "station_id")


@query("f22_effective_bounds", "SELECT id, min_threshold, max_threshold FROM evaluated")
def f22(v):
    from hourlake.operators.alerts import evaluate

    return evaluate(v.metrics, v.iot_devices).select("id", "min_threshold", "max_threshold")


@query("f23_run_id", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN NULL ELSE p_brand END AS run_id FROM part")
def f23(v):
    k, b = F.col("p_partkey") % 3, F.col("p_brand")
    uri = F.when(k == 0, F.concat(F.lit("runs:/"), b, F.lit("/model"))).when(k == 1, F.concat(F.lit("models:/"), b)).otherwise(
        F.concat(F.lit(" runs://"), b, F.lit("/artifacts/model")))
    return v.read("part").select("p_partkey", models.run_id(uri).alias("run_id"))


@query("f24_default_ids", "SELECT location_id, province_id, device_id, hour_ts FROM series")
def f24(v):
    return v.series.select("location_id", "province_id", "device_id", "hour_ts")


@query("f25_alert_enabled", "SELECT id, CASE WHEN id % 3 = 0 THEN alert_enabled ELSE temperature_min_threshold IS NOT NULL AND humidity_max_threshold IS NOT NULL END AS enabled FROM iot_devices")
def f25(v):
    given = F.when(F.col("id") % 3 == 0, F.col("alert_enabled"))
    return v.iot_devices.select("id", measure.alert_enabled(F.col("temperature_min_threshold"), F.col("humidity_max_threshold"), given).alias("enabled"))


@query("f26_capabilities", "SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['temperature', 'humidity'] ELSE string_split(replace(device_type, '_', ','), ',') END) AS capability FROM iot_devices")
def f26(v):
    raw = F.when(F.col("id") % 2 != 0, F.translate("device_type", "_", ","))
    return v.iot_devices.select("id", F.explode(text.capabilities(raw)).alias("capability"))
