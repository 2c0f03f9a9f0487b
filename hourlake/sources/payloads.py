"""JSON messages -> typed rows. Works on batch and streaming frames alike."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import measure, text, when

# fixed values: accepted field names
TEMPERATURE_KEYS = ["temperature", "temp", "t"]
HUMIDITY_KEYS = ["humidity", "hum", "h"]
STATION_KEYS = {
    "temp_f": ["tempf", "tempF", "outdoorTempF", "temperatureF"],
    "temp_c": ["tempc", "tempC", "temperature", "temp"],
    "humidity": ["humidity", "humidityout", "humidityOut", "outdoorHumidity"],
    "dew_f": ["dewPoint", "dewpoint", "dewPointf", "dewpointf", "dewPointF"],
    "dew_c": ["dewPointC", "dewpointC"],
    "time": ["dateutc", "lastUpdated", "last_updated", "created_at", "timestamp"],
}
# after the name inside `info`
STATION_NAMES = ["name", "stationName", "station_name", "location"]
STATION_MACS = ["macAddress", "mac_address", "mac", "id"]


def with_fields(df: DataFrame, json: Column, name: str) -> DataFrame:
    """Adds the top-level fields of an object as a map of texts; rows without an object get NULL.

    The text is parsed once: a generator stands between the parse and its many uses, so the
    optimizer does not copy the parse into each of them.
    """
    return df.select("*", F.explode(F.array(F.from_json(json, "map<string,string>"))).alias(name))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_sensor_json(df: DataFrame, payload: str = "payload", topic: str = "topic",
                      default_id: str = "unknown_device") -> DataFrame:
    """Wide and long sensor messages; anything else is dropped.

    `form` is wide (temperature / humidity set) or long (metric_type / metric_value set).
    """
    g = lambda n: F.try_element_at("_m", F.lit(n))
    num = lambda c: c.try_cast("double")
    rest = [c for c in df.columns if c not in (payload, topic)]
    out = with_fields(df, F.trim(F.col(payload)), "_m").where(F.col("_m").isNotNull())

    def alias(keys: list[str]) -> Column:
        """A shorter name counts only when the longer ones are absent (not merely null)."""
        out = g(keys[-1])
        for k in reversed(keys[:-1]):
            out = F.when(F.map_contains_key("_m", F.lit(k)), g(k)).otherwise(out)
        return num(out)

    out = out.withColumns({"temperature": alias(TEMPERATURE_KEYS), "humidity": alias(HUMIDITY_KEYS)})
    wide = F.col("temperature").isNotNull() | F.col("humidity").isNotNull()
    long = g("metric_type").isNotNull() & num(g("value")).isNotNull()
    out = out.withColumn("form", F.when(wide, "wide").when(long, "long")).where(F.col("form").isNotNull())
    only_long = F.col("form") == "long"
    return out.select(
        *rest,
        "form",
        F.coalesce(_filled(g("source")), _filled(g("sensor_id")), text.sensor_from_topic(F.col(topic), default_id)).alias("sensor_id"),
        g("location").alias("location"),
        g("location_province").alias("location_province"),
        g("timestamp").alias("event_time"),
        g("source_type").alias("source_type"),
        g("provider").alias("provider"),
        g("environment_type").alias("environment_type"),
        num(g("latitude")).alias("latitude"),
        num(g("longitude")).alias("longitude"),
        "temperature",
        "humidity",
        F.coalesce(_filled(g("temperature_unit")), F.lit("C")).alias("temperature_unit"),
        F.coalesce(_filled(g("humidity_unit")), F.lit("%")).alias("humidity_unit"),
        F.when(only_long, g("metric_type")).alias("metric_type"),
        F.when(only_long, num(g("value"))).alias("metric_value"),
        F.when(only_long, F.coalesce(g("unit"), F.lit(""))).alias("unit"),
        F.coalesce(g("saved").try_cast("boolean"), F.lit(True)).alias("saved"),
    )


def parse_station_json(df: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Station payloads: first filled alias wins, Fahrenheit before Celsius, humidity from the dew point if absent."""
    doc = F.col(payload)
    outer = lambda k: F.try_element_at("_doc", F.lit(k))
    is_box = lambda c: c.startswith("{") & (c != "{}")
    df = with_fields(df, doc, "_doc")
    last = doc
    for k in reversed(["lastData", "last_data", "data"]):
        last = F.when(is_box(outer(k)), outer(k)).otherwise(last)
    df = with_fields(df, last, "_last")
    field = lambda k: F.try_element_at("_last", F.lit(k))
    # every choice is made once, for the same reason as the parse
    names = list(STATION_KEYS)
    picked = F.struct(*[text.first_present(*[field(k) for k in STATION_KEYS[n]]).alias(n) for n in names])
    df = df.select("*", F.explode(F.array(picked)).alias("_pick"))
    pick = lambda name: F.col(f"_pick.{name}")
    celsius = lambda f, c: F.when(pick(f).isNotNull(), measure.f_to_c(pick(f))).otherwise(measure.clean_float(pick(c)))
    df = df.withColumns({
        "temperature": celsius("temp_f", "temp_c"),
        "_dew": celsius("dew_f", "dew_c"),
        "_hum": measure.clean_float(pick("humidity")),
    })
    ts, ms = when.parse_epoch_or_iso(pick("time"))
    named = F.coalesce(F.nullif(F.get_json_object(outer("info"), "$.name"), F.lit("")), *[F.nullif(outer(k), F.lit("")) for k in STATION_NAMES])
    mac = F.coalesce(*[F.nullif(outer(k), F.lit("")) for k in STATION_MACS])
    rest = [c for c in df.columns if not c.startswith("_") and c not in (payload, "temperature")]
    return df.select(
        *rest,
        F.coalesce(ts, as_of).alias("event_ts"),
        ms.alias("timestamp_ms"),
        "temperature",
        F.coalesce("_hum", measure.rh_from_dewpoint(F.col("temperature"), F.col("_dew"))).alias("humidity"),
        F.coalesce(named, F.lit("Unknown")).alias("station_name"),
        mac.alias("mac"),
        when.lag_minutes(ts, as_of).alias("lag_minutes"),
    )


STATE = (
    "timestamp string, wifi struct<connected: boolean, ssid: string, ip: string, rssi: int>, "
    "state struct<fan: boolean, fog: boolean, lamp: boolean, auto: boolean>, networks array<string>"
)


def parse_device_state(df: DataFrame, prefix: str, payload: str = "payload", topic: str = "topic") -> DataFrame:
    """Device state messages; non-objects and other topics are dropped."""
    s = F.from_json(F.trim(F.col(payload)), STATE)
    whole = F.trim(F.col(payload)).startswith("{") & F.get_json_object(F.trim(F.col(payload)), "$").isNotNull()
    out = df.withColumn("sensor_id", text.state_sensor_from_topic(F.col(topic), prefix))
    out = out.where(F.col("sensor_id").isNotNull() & whole).withColumn("_s", s)
    g = lambda n: F.col(f"_s.{n}")
    flag = lambda n, d: F.coalesce(g(n), F.lit(d)).alias(n.split(".")[-1])
    rest = [c for c in df.columns if c not in (payload, topic)]
    return out.select(
        *rest, "sensor_id", g("timestamp").alias("event_time"),
        flag("wifi.connected", False), flag("wifi.ssid", ""), flag("wifi.ip", ""), g("wifi.rssi").alias("rssi"),
        flag("state.fan", False), flag("state.fog", False), flag("state.lamp", False), flag("state.auto", True),
        F.coalesce(F.size(g("networks")), F.lit(0)).alias("network_count"),
    )


def explode_hourly(df: DataFrame, keys: list[str], arrays: list[str], time: str = "time") -> DataFrame:
    """Parallel arrays -> one row per hour."""
    return df.select(*keys, F.inline(F.arrays_zip(time, *arrays))).withColumn(
        "event_ts", F.try_to_timestamp(time)
    ).drop(time)
