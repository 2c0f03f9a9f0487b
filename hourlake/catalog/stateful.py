"""Stateful operators: batch forms, and streams drained over the events file."""

import uuid

from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.sources import raw_messages
from hourlake.catalog.views import as_of, SQL_AS_OF, Views
from hourlake.functions import when
from hourlake.operators import alerts, history, quality, rollup, spacing, state, tables
from hourlake.session import exists, shared_dir
from hourlake.streaming import flows


#: Rate limit of the file streams.
FILES_PER_BATCH = 1


class StreamViews(Views):
    """The same views with the events arriving as a file stream."""

    def read(self, name):
        if name != "events":
            return super().read(name)
        schema = super().read(name).schema
        source = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
        if exists(self.spark, f"{self.dir}/events.parquet/*.parquet"):
            return source.parquet(f"{self.dir}/events.parquet")
        return source.option("pathGlobFilter", "events.parquet").parquet(self.dir)


def scratch(v, name):
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def drained(v, stream, name, mode="append"):
    """Run a stream to the end of its input and read what it wrote."""
    out = scratch(v, name)
    q = (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/progress")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_batches(v, stream, write, out):
    flows.start(stream, write, f"{out}/progress").awaitTermination()


def arrivals(v):
    """Messages in arrival order (seq) whose reported time jumps back or is missing."""
    k = F.col("event_id")
    back = F.timestamp_seconds(F.unix_seconds("ts") - (k % 7) * 7200)
    return v.events.select(k.alias("seq"), F.concat(F.lit("sensor_"), "user_id").alias("source"), F.when(k % 50 != 0, back).alias("reported_ts"))


_ARRIVALS = """arrivals AS (SELECT event_id AS seq, 'sensor_' || user_id AS source,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('second', ts) - to_hours(CAST(event_id % 7 * 2 AS INT)) END AS reported_ts FROM events)"""
_STALE = f"""WITH {_ARRIVALS} SELECT seq, source, reported_ts FROM (SELECT *, max(reported_ts) OVER (PARTITION BY source ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arrivals) WHERE reported_ts IS NULL OR top IS NULL OR reported_ts > top"""


@query("x2_drop_stale", _STALE)
def x2(v):
    return state.drop_stale(arrivals(v), "source", "seq", "reported_ts", seconds=1000)


@query("x2_drop_stale_stream", _STALE)
def x2s(v):
    s = StreamViews(v.spark, v.dir)
    return drained(v, flows.drop_stale_stream(arrivals(s), "source", "seq", "reported_ts"), "stale")


@query("x3_threshold_alerts", "SELECT id, source, metric_type, status, current_value, threshold, device_id, unit FROM evaluated WHERE status IS NOT NULL")
def x3(v):
    return v.threshold_alerts.select("id", "source", "metric_type", "status", "current_value", "threshold", "device_id", "unit")


def regional(v):
    """Evaluated metrics keyed by nation and metric, a few rows per hour and key."""
    d = v.iot_devices.select("source", "c_nationkey")
    return alerts.evaluate(v.metrics, v.iot_devices).join(d, "source").select(
        F.concat(F.lit("nation_"), "c_nationkey").alias("place"), "metric_type", "event_ts", "id", "status")


_REGIONAL = """regional AS (SELECT 'nation_' || d.c_nationkey AS place, metric_type, event_ts, e.id, status,
    row_number() OVER (PARTITION BY d.c_nationkey, metric_type ORDER BY event_ts, e.id) AS rn
  FROM evaluated e JOIN iot_devices d ON d.source = e.source)"""
_COOL = f"""WITH RECURSIVE {_REGIONAL},
  fold AS (
    SELECT place, metric_type, event_ts, id, status, rn, status IS NOT NULL AS fired, CASE WHEN status IS NOT NULL THEN event_ts END AS last_ts FROM regional WHERE rn = 1
    UNION ALL
    SELECT e.place, e.metric_type, e.event_ts, e.id, e.status, e.rn,
      e.status IS NOT NULL AND (f.last_ts IS NULL OR epoch_us(e.event_ts) - epoch_us(f.last_ts) >= 21600000000),
      CASE WHEN e.status IS NULL THEN NULL WHEN f.last_ts IS NULL OR epoch_us(e.event_ts) - epoch_us(f.last_ts) >= 21600000000 THEN e.event_ts ELSE f.last_ts END
    FROM fold f JOIN regional e ON e.place = f.place AND e.metric_type = f.metric_type AND e.rn = f.rn + 1)
  SELECT place, metric_type, event_ts, id, status FROM fold WHERE fired"""


@query("x4_apply_cooldown", _COOL)
def x4(v):
    return spacing.apply_cooldown(regional(v), ["place", "metric_type"], "event_ts", "id", seconds=6 * 3600)


@query("x4_apply_cooldown_stream", _COOL)
def x4s(v):
    s = StreamViews(v.spark, v.dir)
    return drained(v, flows.cooldown_stream(regional(s), ["place", "metric_type"], "event_ts", "id", seconds=6 * 3600), "cooldown")


@query("x5_alert_on_change", f"""WITH RECURSIVE {_REGIONAL.replace('FROM evaluated e JOIN iot_devices d ON d.source = e.source', 'FROM evaluated e JOIN iot_devices d ON d.source = e.source WHERE status IS NOT NULL')},
  fold AS (
    SELECT place, metric_type, event_ts, id, status, rn, true AS fired, event_ts AS last_ts, status AS last_status FROM regional WHERE rn = 1
    UNION ALL
    SELECT e.place, e.metric_type, e.event_ts, e.id, e.status, e.rn,
      e.status <> f.last_status OR epoch_us(e.event_ts) - epoch_us(f.last_ts) > 43200000000,
      CASE WHEN e.status <> f.last_status OR epoch_us(e.event_ts) - epoch_us(f.last_ts) > 43200000000 THEN e.event_ts ELSE f.last_ts END,
      CASE WHEN e.status <> f.last_status OR epoch_us(e.event_ts) - epoch_us(f.last_ts) > 43200000000 THEN e.status ELSE f.last_status END
    FROM fold f JOIN regional e ON e.place = f.place AND e.metric_type = f.metric_type AND e.rn = f.rn + 1)
  SELECT place, metric_type, event_ts, id, status FROM fold WHERE fired""")
def x5(v):
    return spacing.alert_on_change(regional(v), ["place", "metric_type"], "event_ts", "id", minutes=720)


_ACT = "PARTITION BY sensor_id ORDER BY event_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("x6_actuator_state", f"""SELECT id, sensor_id,
  coalesce(last_value(CASE WHEN temperature IS NOT NULL THEN temperature >= 32 END IGNORE NULLS) OVER ({_ACT}), false) AS fan,
  coalesce(last_value(CASE WHEN temperature IS NOT NULL THEN temperature <= 25 END IGNORE NULLS) OVER ({_ACT}), false) AS lamp,
  coalesce(last_value(CASE WHEN humidity <= 60 THEN true WHEN humidity >= 75 THEN false END IGNORE NULLS) OVER ({_ACT}), false) AS fog FROM readings""")
def x6(v):
    return state.actuator_state(v.readings).select("id", "sensor_id", "fan", "lamp", "fog")


def control_events(v):
    """Readings plus commands (every purchase event is a command)."""
    k, kind = F.col("event_id"), F.col("event_type")
    cmd = kind == "purchase"
    flag = lambda n, m: F.when(cmd & (k % n != 0), k % m == 0)
    return v.events.where(kind.isin("click", "view", "purchase")).select(
        k.alias("id"), F.concat(F.lit("sensor_"), F.col("user_id") % 100).alias("sensor_id"), F.col("ts").alias("event_ts"),
        F.when(kind == "click", F.col("value")).alias("temperature"), F.when(kind == "view", F.col("value")).alias("humidity"),
        F.when(cmd & (k % 3 == 0), False).when(cmd & (k % 3 == 1), True).alias("set_auto"),
        flag(2, 5).alias("set_fan"), flag(5, 3).alias("set_lamp"), flag(7, 4).alias("set_fog"))


_CONTROL = f"""control AS (SELECT event_id AS id, 'sensor_' || user_id % 100 AS sensor_id, ts AS event_ts,
    CASE WHEN event_type = 'click' THEN value END AS temperature, CASE WHEN event_type = 'view' THEN value END AS humidity,
    CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN false WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN true END AS set_auto,
    CASE WHEN event_type = 'purchase' AND event_id % 2 <> 0 THEN event_id % 5 = 0 END AS set_fan,
    CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN event_id % 3 = 0 END AS set_lamp,
    CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN event_id % 4 = 0 END AS set_fog
  FROM events WHERE event_type IN ('click', 'view', 'purchase')),
  moded AS (SELECT *, coalesce(last_value(set_auto IGNORE NULLS) OVER ({_ACT}), true) AS auto FROM control)"""
_X7 = f"""WITH {_CONTROL} SELECT id, sensor_id, auto,
  coalesce(last_value(CASE WHEN auto AND temperature IS NOT NULL THEN temperature >= 32 WHEN NOT auto THEN set_fan END IGNORE NULLS) OVER ({_ACT}), false) AS fan,
  coalesce(last_value(CASE WHEN auto AND temperature IS NOT NULL THEN temperature <= 25 WHEN NOT auto THEN set_lamp END IGNORE NULLS) OVER ({_ACT}), false) AS lamp,
  coalesce(last_value(CASE WHEN auto AND humidity <= 60 THEN true WHEN auto AND humidity >= 75 THEN false WHEN NOT auto THEN set_fog END IGNORE NULLS) OVER ({_ACT}), false) AS fog
  FROM moded"""


@query("x7_actuator_with_commands", _X7)
def x7(v):
    return state.actuator_with_commands(control_events(v)).select("id", "sensor_id", "auto", "fan", "lamp", "fog")


@query("x7_actuator_stream", _X7)
def x7s(v):
    s = flows.actuator_stream(control_events(StreamViews(v.spark, v.dir)), "sensor_id", "event_ts", "id")
    return drained(v, s, "actuators").select("id", "sensor_id", "auto", "fan", "lamp", "fog")


_LAST = """SELECT sensor_id, metric_type, id, event_ts, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, metric_type
  ORDER BY event_ts DESC, id DESC) AS rn FROM metrics) WHERE rn = 1"""


@query("x8_latest_state", _LAST)
def x8(v):
    return state.latest_state(v.metrics, ["sensor_id", "metric_type"])


@query("x8_latest_state_stream", _LAST)
def x8s(v):
    out = scratch(v, "latest")
    s = StreamViews(v.spark, v.dir)
    run_batches(v, s.metrics, flows.latest_state_sink(f"{out}/t", ["sensor_id", "metric_type"], "event_ts", ["id"]), out)
    return flows.newest_version(v.spark, f"{out}/t").select("sensor_id", "metric_type", "id", "event_ts", "metric_value")


@query("x9_auto_register", """SELECT p.source, p.device_type, d.user_id, d.id AS template_id, d.name,
  CASE p.device_type WHEN 'temperature' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'soil_moisture' THEN '%' WHEN 'light_intensity' THEN 'lux' WHEN 'pressure' THEN 'hPa' END AS unit,
  true AS is_active, false AS alert_enabled
  FROM (SELECT DISTINCT sensor_id AS source, metric_type AS device_type FROM metrics) p JOIN iot_devices d ON d.source = p.source WHERE d.device_type <> p.device_type""")
def x9(v):
    return alerts.auto_register(v.metrics, v.iot_devices)


@query("x11_device_view", f"""SELECT d.id, d.user_id, d.source, d.device_type, l.metric_value AS latest_value, l.event_ts AS latest_event_ts,
  {r(f'(epoch_us({SQL_AS_OF}) - epoch_us(l.event_ts)) / 1000000.0::DOUBLE', 3)} AS lag_seconds,
  CASE WHEN l.metric_value IS NULL OR d.min_threshold IS NULL THEN 'none' WHEN l.metric_value < d.min_threshold OR l.metric_value > d.max_threshold THEN 'out_of_range' ELSE 'normal' END AS alert_status
  FROM iot_devices d LEFT JOIN ({_LAST}) l ON l.sensor_id = d.source AND l.metric_type = d.device_type""")
def x11(v):
    return rounded(history.device_view(v.iot_devices, v.metrics, as_of()), 3)


@query("x13_hourly_rollup_stream", f"""SELECT device_id, hour_ts, {r('temperature_avg')} AS temperature_avg, {r('humidity_avg')} AS humidity_avg, record_count FROM hourly
  WHERE hour_ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(event_ts)) - INTERVAL 2 HOUR FROM silver WHERE quality_flag = 'valid')""")
def x13(v):
    s = StreamViews(v.spark, v.dir)
    rolled = rollup.hourly_rollup_stream(quality.with_flag(s.bronze_raw), "2 hours")
    return rounded(drained(v, rolled, "rollup").select("device_id", "hour_ts", "temperature_avg", "humidity_avg", "record_count"))


@query("x1_ingest_stream", """
  WITH wide AS (SELECT event_id AS id, 'sensor_' || user_id AS sensor_id, value AS temperature, CASE WHEN event_id % 5 = 1 THEN value END AS humidity
    FROM events WHERE event_id % 5 IN (0, 1, 3))
  SELECT 'readings' AS kind, id, sensor_id, NULL AS metric_type, temperature AS metric_value FROM wide
  UNION ALL SELECT 'metrics', id, sensor_id, 'temperature', temperature FROM wide
  UNION ALL SELECT 'metrics', id, sensor_id, 'humidity', humidity FROM wide WHERE humidity IS NOT NULL
  UNION ALL SELECT 'metrics', event_id, 'sensor_' || user_id, 'pressure', value FROM events WHERE event_id % 5 = 2""")
def x1(v):
    out = scratch(v, "ingest")
    no = lambda *names: {n: F.lit(None).cast("string") for n in names}
    dev = v.iot_devices.withColumns({**no("source_type", "environment_type", "location", "location_province"),
                                     "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    q = flows.ingest(raw_messages(StreamViews(v.spark, v.dir)), dev, v.generic_devices, out, f"{out}/progress", as_of())
    q.awaitTermination()
    rd = v.spark.read.parquet(f"{out}/readings").select(
        F.lit("readings").alias("kind"), "id", "sensor_id", F.lit(None).cast("string").alias("metric_type"), F.col("temperature").alias("metric_value"))
    m = v.spark.read.parquet(f"{out}/metrics").select(F.lit("metrics").alias("kind"), "id", "sensor_id", "metric_type", "metric_value")
    return rd.unionByName(m)


@query("k13_bronze_sink", "SELECT event_id, device_id, event_ts, TIMESTAMP '2024-01-31 00:00:00' AS ingested_at FROM bronze_raw")
def k13(v):
    out = scratch(v, "bronze")
    run_batches(v, StreamViews(v.spark, v.dir).bronze_raw, flows.bronze_sink(f"{out}/t", as_of()), out)
    return v.spark.read.parquet(f"{out}/t").select("event_id", "device_id", "event_ts", "ingested_at")


@query("k8_write_table", "SELECT metric_type, count(*) AS n, max(event_ts) AS last_ts FROM metrics GROUP BY 1")
def k8(v):
    lake = tables.Lake(v.spark, scratch(v, "lake"))
    lake.write("metrics", v.metrics, ["metric_type"])
    return lake.table("metrics").groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("last_ts"))


@query("k3_overwrite_partitions", "SELECT metric_type, CASE WHEN metric_type = 'humidity' THEN 0 ELSE count(*) END + CASE WHEN metric_type = 'humidity' THEN count(*) FILTER (metric_value > 50) ELSE 0 END AS n FROM metrics GROUP BY 1")
def k3p(v):
    lake = tables.Lake(v.spark, scratch(v, "parts"))
    lake.write("metrics", v.metrics, ["metric_type"])
    tables.overwrite_partitions(v.metrics.where("metric_type = 'humidity' AND metric_value > 50"), lake.path("metrics"), ["metric_type"])
    return lake.table("metrics").groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))


@query("k9_cluster_write", "SELECT count(*) AS n, count(DISTINCT location_id) AS places FROM reference")
def k9w(v):
    out = scratch(v, "clustered")
    tables.cluster_write(v.reference, ["location_id", "event_ts"], out)
    return v.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("places"))


@query("k12_export_csv", """SELECT rd.sensor_id, d.name AS device_name, strftime(rd.event_ts, '%Y-%m-%dT%H:%M:%S') AS event_ts, CAST(temperature AS VARCHAR) AS temperature
  FROM readings rd LEFT JOIN iot_devices d ON d.source = rd.sensor_id""")
def k12w(v):
    out = scratch(v, "csv")
    history.export_csv(history.export_frame(v.readings, v.iot_devices), out)
    cols = "sensor_id string, device_name string, event_ts string, temperature string, humidity string"
    return v.spark.read.option("header", True).schema(cols).csv(out).drop("humidity")


@query("s9_read_events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s9(v):
    from hourlake.sources.readings import read_events

    schema = v.read("events").schema
    stream = read_events(v.spark, "parquet", schema, v.dir, pathGlobFilter="events.parquet")
    return drained(v, stream.select("event_type", when.as_ts("ts").alias("ts")), "log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
