"""Measured values: quality, units, thresholds, ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
TEMPERATURE_BOUNDS = (-10.0, 60.0)
HUMIDITY_BOUNDS = (0.0, 100.0)
EXPECTED_PER_HOUR = 720
MAGNUS_A, MAGNUS_B = 17.625, 243.04
METRIC_UNITS = {
    "temperature": "°C",
    "humidity": "%",
    "soil_moisture": "%",
    "light_intensity": "lux",
    "pressure": "hPa",
}
LEVELS = {"cpu": (80.0, 90.0), "memory": (85.0, 95.0)}


def quality_flag(
    ts: Column,
    temperature: Column,
    humidity: Column,
    t_bounds=TEMPERATURE_BOUNDS,
    h_bounds=HUMIDITY_BOUNDS,
    strict_nulls: bool = False,
) -> Column:
    """First failing check wins. A missing value passes unless `strict_nulls`."""
    bad_t = ~temperature.between(*t_bounds)
    bad_h = ~humidity.between(*h_bounds)
    if strict_nulls:
        bad_t, bad_h = temperature.isNull() | bad_t, humidity.isNull() | bad_h
    return (
        F.when(ts.isNull(), "invalid_timestamp")
        .when(bad_t, "invalid_temperature")
        .when(bad_h, "invalid_humidity")
        .otherwise("valid")
    )


def clean_float(c: Column) -> Column:
    """Number with 2 decimals; NULL for bad text and NaN."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n), F.round(n, 2))


def f_to_c(c: Column) -> Column:
    return F.round((clean_float(c) - 32.0) * 5.0 / 9.0, 2)


def rh_from_dewpoint(t: Column, d: Column) -> Column:
    """Relative humidity (Magnus), clamped to 0..100, one decimal."""
    gamma = lambda x: F.exp(F.lit(MAGNUS_A) * x / (F.lit(MAGNUS_B) + x))
    rh = F.lit(100.0) * gamma(d) / gamma(t)
    # greatest/least skip NULLs, so guard the inputs
    return F.when(
        t.isNotNull() & d.isNotNull(),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), rh)), 1),
    )


def missing_ratio(n: Column, expected: int = EXPECTED_PER_HOUR) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - n / F.lit(float(expected)))


def coverage_ratio(n: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.coalesce(n, F.lit(0)) / expected.cast("double")).otherwise(F.lit(0.0))


def coverage_status(n: Column, ratio: Column, min_coverage: float) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "failed")
        .when(ratio >= F.lit(min_coverage), "success")
        .otherwise("partial")
    )


def alert_status(v: Column, lo: Column, hi: Column) -> Column:
    """none (no value or not both bounds) / out_of_range / normal."""
    return (
        F.when(v.isNull() | lo.isNull() | hi.isNull(), "none")
        .when((v < lo) | (v > hi), "out_of_range")
        .otherwise("normal")
    )


def breach_status(v: Column, lo: Column, hi: Column) -> Column:
    """critical above the upper bound, warning below the lower; both bounds required."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.when(v > hi, "critical").when(v < lo, "warning"))


def level_status(metric: Column, v: Column, levels=LEVELS) -> Column:
    out = F.lit("normal")
    for name, (warn, crit) in levels.items():
        out = F.when(
            metric == name,
            F.when(v >= crit, "critical").when(v >= warn, "warning").otherwise("normal"),
        ).otherwise(out)
    return out


def default_unit(metric: Column) -> Column:
    m = F.lower(F.trim(metric))
    out = F.lit(None).cast("string")
    for name, unit in METRIC_UNITS.items():
        out = F.when(m == name, unit).otherwise(out)
    return out


def effective_bounds(metric: Column, device_type: Column) -> tuple[Column, Column]:
    """(min, max) that apply to a metric of a device.

    A combined device uses only its per-metric pair. A single-type device uses the
    per-metric pair, or the generic pair when neither per-metric bound is set.
    """
    both = device_type == "temperature_humidity"
    lo, hi = F.col("min_threshold"), F.col("max_threshold")

    def side(i: int) -> Column:
        out = F.when(~both, (lo, hi)[i])
        for m in ("humidity", "temperature"):
            pair = (F.col(f"{m}_min_threshold"), F.col(f"{m}_max_threshold"))
            generic = ~both & pair[0].isNull() & pair[1].isNull()
            out = F.when(metric == m, F.when(generic, (lo, hi)[i]).otherwise(pair[i])).otherwise(out)
        return out

    return side(0), side(1)


def alert_enabled(lo: Column, hi: Column, flag: Column) -> Column:
    return F.coalesce(flag, lo.isNotNull() & hi.isNotNull())


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
