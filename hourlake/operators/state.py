"""Per-sensor state from ordered readings: duplicates, actuators, newest rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlake.operators.prefix import last_known, running_max_before
from hourlake.operators.ranking import latest_per

# fixed values: switching points
FAN_ON, LAMP_ON, FOG_ON, FOG_OFF = 32.0, 25.0, 60.0, 75.0


def drop_stale(df: DataFrame, key: str, seq: str, ts: str, seconds: int = 86_400) -> DataFrame:
    """Keep rows without a time and rows newer than every earlier arrival of the source.

    `seq` is the arrival order; the chunks of the scan run along it.
    """
    cols = df.columns
    marked = running_max_before(df, [key], [F.col(seq)], seq, ts, "_max", seconds)
    keep = F.col(ts).isNull() | F.col("_max").isNull() | (F.col(ts) > F.col("_max"))
    return marked.where(keep).select(cols)


def actuator_state(readings: DataFrame, key: str = "sensor_id", ts: str = "event_ts", tie: str = "id") -> DataFrame:
    """fan, lamp, fog after each reading; fog holds between its two switching points; all start off."""
    t, h = F.col("temperature"), F.col("humidity")
    return _settled(last_known(readings, [key], [ts, tie], ts, {
        "fan": F.when(t.isNotNull(), t >= FAN_ON),
        "lamp": F.when(t.isNotNull(), t <= LAMP_ON),
        "fog": F.when(h <= FOG_ON, True).when(h >= FOG_OFF, False),
    }))


def actuator_with_commands(events: DataFrame, key: str = "sensor_id", ts: str = "event_ts", tie: str = "id") -> DataFrame:
    """The same with manual commands: `auto` switches the mode, which decides who is heard.

    A row is a reading (temperature / humidity) or a command (set_auto, set_fan, set_lamp, set_fog).
    A command's own mode switch counts before its other fields.
    """
    modes = last_known(events, [key], [ts, tie], ts, {"auto": F.col("set_auto")})
    auto = F.coalesce("auto", F.lit(True))
    t, h = F.col("temperature"), F.col("humidity")
    both = modes.withColumn("auto", auto)
    auto = F.col("auto")
    return _settled(last_known(both, [key], [ts, tie], ts, {
        "fan": F.when(auto & t.isNotNull(), t >= FAN_ON).when(~auto, F.col("set_fan")),
        "lamp": F.when(auto & t.isNotNull(), t <= LAMP_ON).when(~auto, F.col("set_lamp")),
        "fog": F.when(auto & (h <= FOG_ON), True).when(auto & (h >= FOG_OFF), False).when(~auto, F.col("set_fog")),
    }))


def _settled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("fan", "lamp", "fog")})


def latest_state(df: DataFrame, keys: list[str], ts: str = "event_ts", ties: list[str] = ("id",)) -> DataFrame:
    return latest_per(df, keys, ts, list(ties))
