"""Sources: snapshots, payload decoding, hourly files, sync planning."""

from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import as_of, SQL_AS_OF
from hourlake.catalog.windows import _LATEST, sync_status
from hourlake.sources import payloads, readings, weather


@query("s1_read_readings", f"""SELECT m.sensor_id AS device_id, coalesce(CASE WHEN m.id % 4 = 0 THEN 'own place' END, 'loc_' || d.c_nationkey) AS location_id,
  'prov_' || d.c_nationkey AS province_id, m.event_ts, m.temperature, m.humidity, 'database' AS source
  FROM readings m LEFT JOIN iot_devices d ON d.source = m.sensor_id WHERE m.event_ts >= {SQL_AS_OF} - INTERVAL 14 DAY""")
def s1(v):
    rd = v.readings.withColumns({
        "device_id": F.lit(None).cast("bigint"), "province_id": F.lit(None).cast("string"),
        "location_id": F.when(F.col("id") % 4 == 0, "own place")})
    dev = v.iot_devices.withColumns({"location": F.concat(F.lit("loc_"), "c_nationkey"), "province": F.concat(F.lit("prov_"), "c_nationkey")})
    return readings.read_readings(rd, dev, 14, as_of())


@query("s2_source_mapping", "SELECT 'sensor_' || user_id AS device_id, event_type AS location_id, props AS province_id, ts AS event_ts, value AS temperature, CAST(event_id AS DOUBLE) AS humidity FROM events")
def s2(v):
    raw = v.events.select(F.concat(F.lit("sensor_"), "user_id").alias("sid"), "event_type", "props", "ts", "value", F.col("event_id").cast("double").alias("hum"))
    m = readings.SourceMapping(device_id="sid", location_id="event_type", province_id="props", event_ts="ts", temperature="value", humidity="hum")
    return m.project(raw)


@query("s4_normalize_hourly", f"""SELECT location_id, province_id, station_id, event_ts, {r('temperature_c')} AS temperature_c, {r('relative_humidity')} AS relative_humidity,
  CAST(NULL AS DOUBLE) AS precipitation, CAST(year(event_ts) AS INT) AS year, CAST(month(event_ts) AS INT) AS month, 'station' AS fetch_method,
  CASE WHEN l_orderkey % 260 <= 75 THEN 'near_station' WHEN l_orderkey % 260 <= 150 THEN 'medium_distance_station' WHEN l_orderkey % 260 <= 200 THEN 'far_station' ELSE 'too_far_station' END AS data_quality
  FROM reference_raw""")
def s4(v):
    raw = v.reference_raw.select("location_id", "station_id", F.col("event_ts").alias("time"), F.col("temperature_c").alias("temp"),
                                 F.col("relative_humidity").alias("rhum"), (F.col("l_orderkey") % 260).cast("double").alias("distance_km"))
    out = weather.normalize_hourly(raw, v.dim_location)
    return rounded(out.select("location_id", "province_id", "station_id", "event_ts", "temperature_c", "relative_humidity", "precipitation",
                              "year", "month", "fetch_method", "data_quality"))


@query("s5_seed_dims", """SELECT 'province' AS kind, province_id AS id, province_name AS name FROM dim_province WHERE province_id IN (SELECT province_id FROM dim_location WHERE starts_with(location_id, 'loc34_'))
  UNION ALL SELECT 'location', location_id, location_name FROM dim_location WHERE starts_with(location_id, 'loc34_')""")
def s5(v):
    rows = v.dim_location.join(v.dim_province, "province_id")
    prov, loc = weather.seed_dims(rows.unionByName(rows), "current_34")
    return prov.select(F.lit("province").alias("kind"), F.col("province_id").alias("id"), F.col("province_name").alias("name")).unionByName(
        loc.select(F.lit("location").alias("kind"), F.col("location_id").alias("id"), F.col("location_name").alias("name")))


def raw_messages(v):
    """One JSON message per event in five shapes, with its topic."""
    k, val = F.col("event_id") % 5, F.col("value").cast("string")
    sid = F.concat(F.lit("sensor_"), F.col("user_id"))
    q = lambda name, x: F.concat(F.lit(f'"{name}":"'), x, F.lit('"'))
    n = lambda name, x: F.concat(F.lit(f'"{name}":'), x)
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    payload = (
        F.when(k == 0, obj(q("sensor_id", sid), n("temperature", val)))
        .when(k == 1, obj(q("source", sid), n("temp", val), n("hum", val)))
        .when(k == 2, obj(q("sensor_id", sid), q("metric_type", F.lit("pressure")), n("value", val)))
        .when(k == 3, obj(n("t", val), q("location", F.lit("hall"))))
        .otherwise(F.lit("not-json"))
    )
    return v.events.select(F.col("event_id").alias("id"), F.col("ts").alias("received_at"), payload.alias("payload"),
                           F.concat(F.lit("sensors/"), sid, F.lit("/data")).alias("topic"))


@query("s6_parse_sensor_json", """SELECT event_id AS id, 'sensor_' || user_id AS sensor_id, CASE event_id % 5 WHEN 2 THEN 'long' ELSE 'wide' END AS form,
  CASE WHEN event_id % 5 IN (0, 1, 3) THEN value END AS temperature, CASE WHEN event_id % 5 = 1 THEN value END AS humidity,
  CASE WHEN event_id % 5 = 2 THEN 'pressure' END AS metric_type, CASE WHEN event_id % 5 = 2 THEN value END AS metric_value,
  CASE WHEN event_id % 5 = 3 THEN 'hall' END AS location FROM events WHERE event_id % 5 <> 4""")
def s6(v):
    out = payloads.parse_sensor_json(raw_messages(v))
    return out.select("id", "sensor_id", "form", "temperature", "humidity", "metric_type", "metric_value", "location")


def station_messages(v):
    k, val = F.col("event_id") % 4, F.col("value").cast("string")
    ms = F.unix_millis("ts").cast("string")
    payload = (
        F.when(k == 0, F.concat(F.lit('{"macAddress":"m1","info":{"name":"st"},"lastData":{"tempf":'), val, F.lit(',"humidity":55.555,"dateutc":'), ms, F.lit("}}")))
        .when(k == 1, F.concat(F.lit('{"mac":"m2","stationName":"sn","last_data":{"tempF":"","tempc":"'), val, F.lit('","dewPointC":5,"timestamp":"'),
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}}')))
        .when(k == 2, F.concat(F.lit('{"id":"m3","lastData":{},"data":{"temperature":'), val, F.lit(',"humidityOut":"bad"}}')))
        .otherwise(F.concat(F.lit('{"temp":'), val, F.lit(',"dateutc":'), F.unix_seconds("ts").cast("string"), F.lit("}")))
    )
    return v.events.select(F.col("event_id").alias("id"), payload.alias("payload"))


_RH = "greatest(0, least(100, 100 * exp(17.625::DOUBLE * 5 / (243.04::DOUBLE + 5)) / exp(17.625::DOUBLE * value / (243.04::DOUBLE + value))))"


@query("s7_parse_station_json", f"""SELECT event_id AS id, {r('CASE WHEN event_id % 4 = 0 THEN round((value - 32) * 5 / 9, 2) ELSE value END')} AS temperature,
  {r(f'CASE event_id % 4 WHEN 0 THEN 55.56 WHEN 1 THEN round({_RH}, 1) END')} AS humidity,
  CASE event_id % 4 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 2 THEN {SQL_AS_OF} ELSE date_trunc('second', ts) END AS event_ts,
  CASE event_id % 4 WHEN 0 THEN 'st' WHEN 1 THEN 'sn' ELSE 'Unknown' END AS station_name, CASE event_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' WHEN 2 THEN 'm3' END AS mac,
  CASE event_id % 4 WHEN 2 THEN NULL WHEN 0 THEN round((epoch_us({SQL_AS_OF}) // 1000 - epoch_us(ts) // 1000) / 60000.0::DOUBLE, 1)
    ELSE round((epoch_us({SQL_AS_OF}) // 1000000 - epoch_us(ts) // 1000000) / 60.0::DOUBLE, 1) END AS lag_minutes FROM events""")
def s7(v):
    out = payloads.parse_station_json(station_messages(v), as_of())
    return rounded(out.select("id", "temperature", "humidity", "event_ts", "station_name", "mac", "lag_minutes"))


@query("s8_explode_hourly", f"""SELECT location_id, event_ts, {r('temperature_c')} AS temperature_2m, {r('relative_humidity')} AS relative_humidity_2m FROM reference""")
def s8(v):
    """Hourly rows are packed into parallel arrays per place and day, then unpacked."""
    pack = v.reference.groupBy("location_id", F.to_date("event_ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("event_ts", "temperature_c", "relative_humidity"))).alias("h"))
    arrays = pack.select(
        "location_id", F.transform("h", lambda x: F.date_format(x["event_ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("h", lambda x: x["temperature_c"]).alias("temperature_2m"),
        F.transform("h", lambda x: x["relative_humidity"]).alias("relative_humidity_2m"))
    return rounded(payloads.explode_hourly(arrays, ["location_id"], ["temperature_2m", "relative_humidity_2m"]))


@query("s10_read_since", """SELECT id, sensor_id, event_ts FROM metrics WHERE metric_type <> 'pressure'
    AND event_ts > (CASE WHEN metric_type = 'temperature' THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-10' END) OR metric_type = 'pressure'""")
def s10(v):
    day = lambda d: F.lit(d).cast("timestamp")
    marks = v.metrics.where("metric_type <> 'pressure'").groupBy("metric_type").agg(
        F.max(F.when(F.col("metric_type") == "temperature", day("2024-01-20")).otherwise(day("2024-01-10"))).alias("last_synced_event_ts"))
    return readings.read_since(v.metrics, marks, "metric_type").select("id", "sensor_id", "event_ts")


@query("s10_next_marks", "SELECT metric_type, max(event_ts) AS last_synced_event_ts FROM metrics GROUP BY 1")
def s10n(v):
    return readings.next_marks(v.metrics, "metric_type")


def _plan_sql(mode):
    rule = {"new": "NOT EXISTS (SELECT 1 FROM latest l WHERE l.location_id = p.location_id AND l.year = p.year AND l.status = 'success')",
            "retry_failed": "EXISTS (SELECT 1 FROM latest l WHERE l.location_id = p.location_id AND l.year = p.year AND l.status = 'failed')",
            "overwrite": "true"}[mode]
    return f"""WITH {_LATEST}, pairs AS (SELECT DISTINCT 'loc_' || c_custkey % 60 AS location_id, CAST(y.year AS INT) AS year FROM customer, (VALUES (2022), (2023), (2024)) y(year))
      SELECT location_id, year FROM pairs p WHERE {rule}"""


def _plan(v, mode):
    places = v.read("customer").select(F.concat(F.lit("loc_"), F.col("c_custkey") % 60).alias("location_id"))
    return weather.plan_sync(places, [2022, 2023, 2024], sync_status(v), mode)


@query("s11_plan_sync", _plan_sql("new"))
def s11(v):
    return _plan(v, "new")


@query("s11_plan_sync_retry", _plan_sql("retry_failed"))
def s11r(v):
    return _plan(v, "retry_failed")


@query("s11_plan_sync_overwrite", _plan_sql("overwrite"))
def s11o(v):
    return _plan(v, "overwrite")


@query("s12_parse_device_state", """SELECT event_id AS id, 'dev_' || user_id AS sensor_id, event_id % 5 = 0 AS connected, CASE WHEN event_id % 5 = 0 THEN 'net' ELSE '' END AS ssid,
  CASE WHEN event_id % 5 = 0 THEN CAST(-(event_id % 90) AS INT) END AS rssi, event_id % 5 = 0 AS fan, false AS fog, event_id % 5 <> 1 AS auto,
  CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS network_count FROM events WHERE event_id % 5 IN (0, 1)""")
def s12(v):
    k, u = F.col("event_id") % 5, F.col("user_id")
    payload = (F.when(k == 0, F.concat(F.lit('{"wifi":{"connected":true,"ssid":"net","rssi":-'), F.col("event_id") % 90,
                                       F.lit('},"state":{"fan":true},"networks":[{"ssid":"a"},{"ssid":"b"}]}')))
               .when(k == 1, '{"state":{"auto":false}}').when(k == 2, "[1,2]").when(k == 3, "broken{").otherwise('{"wifi":{}}'))
    topic = F.concat(F.lit("site/devices/dev_"), u, F.when(k == 4, "/wifi-list").otherwise("/state"))
    m = v.events.select(F.col("event_id").alias("id"), payload.alias("payload"), topic.alias("topic"))
    return payloads.parse_device_state(m, "site").select("id", "sensor_id", "connected", "ssid", "rssi", "fan", "fog", "auto", "network_count")
