"""Joins of readings with places, dimensions and reference weather.

No join carries a broadcast hint: Spark broadcasts a side only under its own
size check (autoBroadcastJoinThreshold), else shuffles with AQE skew handling.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.operators.ranking import keep_first, latest_per, oldest


def join_weather(meteo: DataFrame, sensor_hourly: DataFrame) -> DataFrame:
    """Reference hour with the sensor hours of the same place; one row per device, if any."""
    m = meteo.select(
        "location_id",
        "province_id",
        F.date_trunc("hour", "event_ts").alias("hour_ts"),
        F.col("temperature_c").alias("meteostat_temperature"),
        F.col("relative_humidity").alias("meteostat_humidity"),
    )
    s = sensor_hourly.select(
        "location_id",
        "hour_ts",
        "device_id",
        F.col("temperature_avg").alias("esp32_temperature_avg"),
        F.col("humidity_avg").alias("esp32_humidity_avg"),
    )
    return m.join(s, ["location_id", "hour_ts"], "left").select(
        "location_id",
        "province_id",
        "device_id",
        "hour_ts",
        "esp32_temperature_avg",
        "esp32_humidity_avg",
        "meteostat_temperature",
        "meteostat_humidity",
    )


def active_only(df: DataFrame, dim_province: DataFrame) -> DataFrame:
    active = dim_province.where(F.coalesce("is_active", F.lit(True))).select("province_id")
    return df.join(active, "province_id", "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str, cols: list[str], default: str | None = "unknown") -> DataFrame:
    """Attach attributes of a dimension that may repeat keys (smallest values win)."""
    one = keep_first(dim.select(key, *cols), [key], oldest(*cols))
    out = df.drop(*cols).join(one, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(default)) for c in cols}) if default is not None else out


def forecast_entities(devices: DataFrame, locations: DataFrame, no_device: str = "meteostat_only") -> DataFrame:
    """Devices at the chosen places; the pseudo device per place only when there is no device at all."""
    places = locations.select("location_id", "province_id").distinct()
    real = devices.select("device_id", "location_id").distinct().join(places, "location_id")
    none = real.agg((F.count(F.lit(1)) == 0).alias("none"))
    pseudo = places.withColumn("device_id", F.lit(no_device)).where(none.scalar())
    cols = ["device_id", "location_id", "province_id"]
    return real.select(cols).unionByName(pseudo.select(cols))


def nearest_obs(alerts: DataFrame, obs: DataFrame, keys: list[str], ts: str = "created_at",
                obs_ts: str = "event_ts", values: list[str] = ()) -> DataFrame:
    """Closest observation of the same place and calendar day; earlier one on a tie.

    The day's observations are folded to one row per place and day (at most 24
    hours), so the join is one to one and no pairs are emitted.
    """
    hourly = keep_first(
        obs.withColumn("_hour", F.date_trunc("hour", obs_ts)), [*keys, "_hour"], oldest(obs_ts, *values)
    )
    days = hourly.groupBy(*keys, F.to_date(obs_ts).alias("_day")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(obs_ts).alias("obs_ts"), *values))).alias("_obs")
    )
    gap = lambda o: F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(o["obs_ts"]))
    best = F.element_at(
        F.array_sort(
            F.transform(
                "_obs",
                lambda o: F.struct(gap(o).alias("gap"), o["obs_ts"].alias("obs_ts"), *[o[v].alias(v) for v in values]),
            )
        ),
        1,
    )
    out = alerts.withColumn("_day", F.to_date(ts)).join(days, [*keys, "_day"], "left")
    out = out.withColumn("_best", best)
    return out.select(
        *alerts.columns, F.col("_best.obs_ts").alias("obs_ts"), *[F.col(f"_best.{v}").alias(v) for v in values]
    )


def primary_by_source(devices: DataFrame) -> DataFrame:
    """One device row per source: the combined type first, then the lowest id."""
    combined = F.when(F.col("device_type") == "temperature_humidity", 0).otherwise(1)
    return keep_first(devices, ["source"], [combined.asc(), F.col("id").asc()])


def attach_thresholds(metrics: DataFrame, devices: DataFrame, source: str = "sensor_id") -> DataFrame:
    """The device of a metric: exact (source, type) row, else the lowest id of the source.

    Both look-ups have one row per key, so the metric side never multiplies.
    """
    cols = [c for c in devices.columns if c != "source"]
    pack = F.struct(*cols)
    exact = keep_first(devices, ["source", "device_type"], [F.col("id").asc()]).select(
        F.col("source").alias("_s1"), F.col("device_type").alias("_t1"), pack.alias("_exact")
    )
    base = keep_first(devices, ["source"], [F.col("id").asc()]).select(
        F.col("source").alias("_s2"), pack.alias("_base")
    )
    m = metrics.join(base, metrics[source] == F.col("_s2"))
    m = m.join(exact, (F.col(source) == F.col("_s1")) & (F.col("metric_type") == F.col("_t1")), "left")
    dev = F.coalesce("_exact", "_base")
    taken = set(metrics.columns)
    named = [dev[c].alias(f"device_{c}" if c in taken or c in ("id", "name", "unit") else c) for c in cols]
    return m.select(*metrics.columns, *named)


def enrich_readings(readings: DataFrame, devices: DataFrame, generic: DataFrame) -> DataFrame:
    """Payload value, else the device's, else the literal default.

    The place is the active device's label, else the generic device's, else the
    payload's; placeholders count as missing.
    """
    from hourlake.functions.text import null_placeholder

    first = keep_first(devices, ["source"], [F.col("is_active").desc_nulls_last(), F.col("id").asc()])
    own = {"source_type": "physical_iot", "environment_type": "indoor", "location": None,
           "location_province": None, "latitude": None, "longitude": None}
    d = first.select(
        F.col("source").alias("_src"), F.col("id").alias("device_id"), *[F.col(c).alias(f"_d_{c}") for c in own]
    )
    g = keep_first(generic, ["source"], [F.col("id").asc()]).select(
        F.col("source").alias("_gsrc"), F.col("location").alias("_g_location")
    )
    out = readings.join(d, readings["sensor_id"] == F.col("_src"), "left")
    out = out.join(g, F.col("sensor_id") == F.col("_gsrc"), "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"_d_{c}"), *([F.lit(v)] if v else [])) for c, v in own.items() if c != "location"
    }
    filled["location"] = F.coalesce(
        null_placeholder(F.col("_d_location")), null_placeholder(F.col("_g_location")), null_placeholder(F.col("location"))
    )
    filled["temperature_unit"] = F.coalesce("temperature_unit", F.lit("C"))
    filled["humidity_unit"] = F.coalesce("humidity_unit", F.lit("%"))
    return out.withColumns(filled).select(*readings.columns, "device_id")


def sensor_list(devices: DataFrame, readings: DataFrame, virtual: str = "virtual_meteostat") -> DataFrame:
    """Non-virtual devices with their newest reading, once for the owner and once for the admin role.

    All admins see the same rows, so the role stands for them and nothing is multiplied by user.
    """
    real = devices.where(F.coalesce("source_type", F.lit("physical_iot")) != virtual)
    latest = latest_per(readings, ["sensor_id"], "event_ts", ["id"]).select(
        F.col("sensor_id").alias("source"), F.col("event_ts").alias("latest_event_ts"), "temperature", "humidity"
    )
    viewers = F.explode(F.array(F.concat(F.lit("user:"), F.col("user_id")), F.lit("admin")))
    return real.join(latest, "source", "left").withColumn("viewer", viewers)


def notification_targets(alerts: DataFrame, devices: DataFrame, users: DataFrame, targets: DataFrame) -> DataFrame:
    """(alert, channel, address): the owner's enabled targets, else the legacy address of that channel."""
    owner = keep_first(devices, ["source"], [F.col("id").asc()]).select("source", "user_id")
    a = alerts.select(F.col("id").alias("alert_id"), "source").join(owner, "source")
    on = targets.where("is_enabled").select("user_id", F.col("target_type").alias("channel"), F.col("target_value").alias("address"))
    direct = a.join(on, "user_id")
    legacy = users.select(
        "user_id",
        F.explode(
            F.array(
                F.struct(F.lit("telegram").alias("channel"), F.when(F.col("telegram_enabled"), F.col("telegram_chat_id")).alias("address")),
                F.struct(F.lit("email").alias("channel"), F.when(F.col("email_enabled"), F.coalesce("notification_email", "email")).alias("address")),
            )
        ).alias("c"),
    ).select("user_id", "c.channel", "c.address").where(F.coalesce("address", F.lit("")) != "")
    fallback = legacy.join(on.select("user_id", "channel").distinct(), ["user_id", "channel"], "left_anti")
    cols = ["alert_id", "user_id", "channel", "address"]
    return direct.select(cols).unionByName(a.join(fallback, "user_id").select(cols))


def new_rows(cands: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys (NULL-safe) do not occur in `existing`."""
    e = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys])
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        on = c if i == 0 else on & c
    return cands.join(e, on, "left_anti")


#: What a key follows: the sorted `by` values, and one of PARTS parts of the keys that follow the same ones.
SHARED, PARTS = "_series", 16


def shared_by(keys: list[str], values: Column) -> Column:
    return F.struct(F.pmod(F.hash(*keys), F.lit(PARTS)).alias("part"), values.alias("of")).alias(SHARED)


def shared_series(members: DataFrame, forecast: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """(one row per key with its series, the rows of each series).

    `members` says which `by` values a key follows, a value as often as there are rows for it.
    Whatever is worked out per series is worked out once a part, not for each of its keys.
    """
    followers = members.groupBy(*keys).agg(F.sort_array(F.collect_list(by)).alias("_of")).select(*keys, shared_by(keys, F.col("_of")))
    each = followers.select(SHARED).distinct().select(SHARED, F.explode(F.col(SHARED)["of"]).alias(by))
    return followers, each.join(forecast, by).drop(by)


def beside(actual: DataFrame, followers: DataFrame, series: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Full outer join, on keys and time, of actual rows and the rows of the series that their keys follow.

    Actual rows look up their matches. All other series rows go to their keys in the last step, which
    leaves out the matched times of a key (a list no longer than its series), so that the copies of a
    series are never shuffled or grouped. Keys are dealt out by number: a few MB of them become all the
    copies, and by their size they would be put into one task.
    """
    mine, theirs = [c for c in actual.columns if c not in (*keys, ts)], [c for c in series.columns if c not in (SHARED, ts)]
    found = actual.join(followers, keys, "left").join(series.withColumn("_hit", F.lit(True)), [SHARED, ts], "left")
    seen = found.where("_hit").groupBy(*keys).agg(F.collect_set(ts).alias("_seen"))
    dealt = followers.join(seen, keys, "left").repartition(shuffle_partitions(actual), SHARED)
    left = dealt.join(series, SHARED).where(~F.coalesce(F.array_contains("_seen", F.col(ts)), F.lit(False)))
    return found.select(*keys, ts, *mine, *theirs).unionByName(left.select(*keys, ts, *theirs), allowMissingColumns=True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
