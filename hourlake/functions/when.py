"""Time: truncation, calendar parts, parsing, ages."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "+07:00"
MILLIS_FROM = 10_000_000_000  # larger epoch numbers are milliseconds


def as_ts(c) -> Column:
    """`timestamp` from timestamp or timestamp_ntz; NTZ has no epoch cast."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", as_ts(ts))


def minute_key(ts) -> Column:
    return F.date_trunc("minute", as_ts(ts))


def calendar(ts) -> list[Column]:
    """hour, day_of_week (Sunday = 1) and month."""
    ts = as_ts(ts)
    return [
        F.hour(ts).alias("hour"),
        F.dayofweek(ts).alias("day_of_week"),
        F.month(ts).alias("month"),
    ]


def cyclic(name: str, period: int, out: str | None = None) -> list[Column]:
    """sin and cos of a calendar part over its period."""
    angle = F.col(name) * F.lit(2.0 * math.pi / period)
    out = out or name
    return [F.sin(angle).alias(f"{out}_sin"), F.cos(angle).alias(f"{out}_cos")]


def epoch_seconds(ts) -> Column:
    """Fractional epoch seconds as double."""
    return F.unix_micros(as_ts(ts)) / F.lit(1e6)


def parse_epoch_or_iso(c: Column) -> tuple[Column, Column]:
    """(timestamp, epoch milliseconds) from epoch s / ms or an ISO text; naive = UTC."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9.0e15))
    whole = F.when(finite, F.floor(F.abs(number)) * F.signum(number)).cast("bigint")
    from_number = F.when(whole > MILLIS_FROM, whole).when(whole.isNotNull(), whole * 1000)
    iso = F.try_to_timestamp(F.nullif(text, F.lit("")))
    millis = F.coalesce(from_number, F.when(number.isNull(), F.unix_millis(iso)))
    return F.timestamp_millis(millis), millis


def to_local(c: Column, as_of: Column, tz: str = LOCAL_TZ) -> Column:
    """Naive local time: offsets are converted, naive text is kept, bad text becomes `as_of`."""
    parsed = F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))
    aware = F.trim(c).rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.when(aware, F.from_utc_timestamp(parsed, tz)).otherwise(parsed), as_of)


def lag_seconds(ts, as_of: Column) -> Column:
    return epoch_seconds(as_of) - epoch_seconds(ts)


def age_minutes(ts, as_of: Column) -> Column:
    """Minutes since ts, never negative, one decimal."""
    return F.round(F.greatest(F.lit(0.0), lag_seconds(ts, as_of) / F.lit(60.0)), 1)


def lag_minutes(ts, as_of: Column) -> Column:
    return F.round(lag_seconds(ts, as_of) / F.lit(60.0), 1)


def expected_hours(year: Column) -> Column:
    """Hours from Jan 1 to the next Jan 1, both ends counted."""
    first, nxt = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1))
    return (F.datediff(nxt, first) * 24 + 1).cast("int")
