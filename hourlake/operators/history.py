"""History by range, freshness, alert lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import when
from hourlake.operators.ranking import latest_per, newest, keep_first

SEARCH_FIELDS = ["metric_type", "source", "location", "message", "status", "alert_origin"]


def history(df: DataFrame, metric: str, minutes: int, as_of: Column) -> DataFrame:
    """Rows of one metric in the last minutes, oldest first."""
    since = as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return df.where((F.col("metric_type") == metric) & (F.col("event_ts") >= since)).orderBy("event_ts", "id")


def history_by_date(df: DataFrame, first: str, last: str, tz: str = when.LOCAL_TZ, ts: str = "event_ts"):
    """Whole local days, [first 00:00, last + 1 day)."""
    lo = F.to_utc_timestamp(F.lit(first).cast("timestamp"), tz)
    hi = F.to_utc_timestamp(F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"), tz)
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def resolve_window(first: str | None, last: str | None, minutes: int, as_of: Column) -> tuple[Column, Column]:
    """Bounds of a day range, ends included; swapped days are put right, one day stands for both.

    Without any day: the last minutes.
    """
    if not first and not last:
        return as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES"), as_of
    a, b = (F.lit(d).cast("timestamp") for d in (first or last, last or first))
    end = F.greatest(a, b) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return F.least(a, b), end


def between(df: DataFrame, bounds: tuple[Column, Column], ts: str = "event_ts") -> DataFrame:
    return df.where((F.col(ts) >= bounds[0]) & (F.col(ts) <= bounds[1]))


def fresh_only(df: DataFrame, keys: list[str], seconds: int, as_of: Column, ties=("id",)) -> DataFrame:
    """Newest row per key, absent when older than `seconds`. Old rows are filtered before the shuffle."""
    since = as_of - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return latest_per(df.where(F.col("event_ts") >= since), keys, "event_ts", list(ties))


def alerts_query(df, as_of: Column, hours=None, unresolved=False, metric=None, source=None, text=None):
    if hours is not None:
        df = df.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    if unresolved:
        df = df.where(F.col("resolved_at").isNull())
    if metric and metric != "all":
        df = df.where(F.col("metric_type") == metric)
    if source and source != "all":
        df = df.where(F.col("source") == source)
    if text and text.strip():
        fields = [F.lower(F.coalesce(c, F.lit(""))) for c in SEARCH_FIELDS if c in df.columns]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(f, F.lit(text.strip().lower()))
        df = df.where(hit)
    return df


def recent_alerts(df: DataFrame, hours: int, n: int, as_of: Column) -> DataFrame:
    return alerts_query(df, as_of, hours).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def future_only(fc: DataFrame, actual: DataFrame, keys: list[str], as_of: Column, bounds) -> DataFrame:
    """Forecast rows of the range that lie after both now and the newest actual row of the key."""
    last = between(actual, bounds).groupBy(*keys).agg(F.max("event_ts").alias("_last"))
    j = fc.join(last, keys, "left")
    return between(j, bounds, "forecast_ts").where(F.col("forecast_ts") > F.greatest(F.col("_last"), as_of)).drop("_last")


def export_frame(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows of the CSV export: sensor, device name, ISO time, values as text, empty for NULL."""
    name = keep_first(devices, ["source"], [F.col("id").asc()]).select(
        F.col("source").alias("sensor_id"), F.col("name").alias("device_name")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return readings.join(name, "sensor_id", "left").select(
        "sensor_id",
        F.coalesce("device_name", F.lit("")).alias("device_name"),
        F.coalesce(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("event_ts"),
        text("temperature"),
        text("humidity"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def device_view(devices: DataFrame, metrics: DataFrame, as_of: Column) -> DataFrame:
    """Newest value of each device's own metric, its lag and its alert status."""
    from hourlake.functions.measure import alert_status

    last = latest_per(metrics, ["sensor_id", "metric_type"], "event_ts", ["id"]).select(
        F.col("sensor_id").alias("source"), F.col("metric_type").alias("device_type"),
        F.col("metric_value").alias("latest_value"), F.col("event_ts").alias("latest_event_ts"),
    )
    return devices.join(last, ["source", "device_type"], "left").select(
        "id", "user_id", "source", "device_type", "latest_value", "latest_event_ts",
        F.round(when.lag_seconds(F.col("latest_event_ts"), as_of), 3).alias("lag_seconds"),
        alert_status(F.col("latest_value"), F.col("min_threshold"), F.col("max_threshold")).alias("alert_status"),
    )


def inbox(conversations: DataFrame, messages: DataFrame, order: list[str], preview: int = 120) -> DataFrame:
    """Unread counts per side and the last message's first characters."""
    m = messages.join(
        conversations.select(F.col("id").alias("conversation_id"), "last_read_by_user_at", "last_read_by_admin_at"),
        "conversation_id",
    )
    unread = lambda who, cursor: F.count_if(
        F.col("sender_type").isin(*who) & F.coalesce(F.col("created_at") > F.col(cursor), F.col(cursor).isNull())
    )
    agg = m.groupBy("conversation_id").agg(
        F.max_by(F.substring("content", 1, preview), F.struct(*order)).alias("last_message_preview"),
        unread(("admin", "system"), "last_read_by_user_at").alias("unread_for_user"),
        unread(("user",), "last_read_by_admin_at").alias("unread_for_admin"),
    )
    return conversations.select(F.col("id").alias("conversation_id")).join(agg, "conversation_id", "left").select(
        "conversation_id",
        F.coalesce("last_message_preview", F.lit("")).alias("last_message_preview"),
        F.coalesce("unread_for_user", F.lit(0)).alias("unread_for_user"),
        F.coalesce("unread_for_admin", F.lit(0)).alias("unread_for_admin"),
    )


def user_context(users, devices, readings, alerts, as_of: Column, hours: int = 24, cap: int = 20, sample: int = 5):
    """Per user: active devices, sensors with a reading, recent alerts (count capped) and a sample of them."""
    active = devices.where("is_active").groupBy("user_id").agg(F.count(F.lit(1)).alias("active_devices"))
    own = devices.where("is_active").select("user_id", F.col("source").alias("sensor_id")).distinct()
    last = latest_per(readings, ["sensor_id"], "event_ts", ["id"]).join(own, "sensor_id")
    seen = last.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sensors_with_reading"), F.max("event_ts").alias("latest_event_ts")
    )
    recent = alerts.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    mine = recent.join(own, recent["source"] == own["sensor_id"])
    top = keep_first(mine, ["user_id"], newest("created_at", "id"), cap)
    first = keep_first(top, ["user_id"], newest("created_at", "id"), sample)
    n = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent_alerts"))
    names = first.groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id")), asc=False), lambda x: x["id"].cast("string")), ",").alias("alert_sample")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        users.select("user_id").join(active, "user_id", "left").join(seen, "user_id", "left")
        .join(n, "user_id", "left").join(names, "user_id", "left")
        .select("user_id", zero("active_devices"), zero("sensors_with_reading"), "latest_event_ts",
                zero("recent_alerts"), F.coalesce("alert_sample", F.lit("")).alias("alert_sample"))
    )


def admin_stats(users, alerts, devices) -> DataFrame:
    """One row of counts."""
    n = F.count(F.lit(1))
    return users.agg(
        n.alias("users"), F.count_if(~F.col("is_approved")).alias("pending_users")
    ).select(
        "*",
        alerts.agg(n.alias("n")).scalar().alias("alerts"),
        alerts.agg(F.count_if(F.col("resolved_at").isNull()).alias("n")).scalar().alias("open_alerts"),
        devices.agg(F.count_distinct("source").alias("n")).scalar().alias("sensors"),
    )
