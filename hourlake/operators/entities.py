"""Resolve sensors to forecast places by id, text or slug, without an OR join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import text

PLACE_FIRST, DIRECT = 0, 1


def _keys(kind: str, rank: int, values: Column) -> Column:
    return F.transform(
        F.array_distinct(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"), F.lit(rank).alias("rank")),
    )


def _lower(*cols: str) -> Column:
    return F.array(*[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in cols])


def sensor_keys(sensors: DataFrame, places=("location", "location_query", "location_province"),
                ids=("sensor_id", "id", "source", "name")) -> DataFrame:
    """(sensor_id, kind, key, rank): place texts and slugs come first, direct ids second."""
    places = [p for p in places if p in sensors.columns]
    ids = [i for i in ids if i in sensors.columns]
    parts = [_keys("text", PLACE_FIRST, F.flatten(F.array(*[text.text_variants(F.col(p)) for p in places]))),
             _keys("slug", PLACE_FIRST, F.flatten(F.array(*[text.slug_variants(F.col(p)) for p in places]))),
             _keys("direct", DIRECT, _lower(*ids))]
    return sensors.select("sensor_id", F.explode(F.concat(*parts)).alias("k")).select("sensor_id", "k.*")


def place_keys(forecast: DataFrame, locations: DataFrame) -> DataFrame:
    """(kind, key, device_id, location_id) under which a forecast series can be found."""
    series = forecast.select("device_id", "location_id").distinct()
    dl = locations.select(
        F.col("location_id").alias("dl_id"), "location_name", "province_id"
    )
    j = series.join(dl, series["location_id"] == dl["dl_id"], "left")
    by = ["location_id", "dl_id", "location_name", "province_id"]
    parts = [
        _keys("text", 0, _lower(*by)),
        _keys("slug", 0, F.array(*[text.table_key(F.col(c)) for c in by])),
        _keys("direct", 0, _lower("device_id", "location_id")),
    ]
    return j.select("device_id", "location_id", F.explode(F.concat(*parts)).alias("k")).select(
        "k.kind", "k.key", "device_id", "location_id"
    ).distinct()


def resolve_entities(sensors: DataFrame, forecast: DataFrame, locations: DataFrame, **kw) -> DataFrame:
    """(sensor_id, device_id, location_id): all series of the first attempt that finds any.

    The first rank that finds anything is settled on keys alone; only then do sensors meet
    the series of their key, so no set of series is ever gathered in one row.
    """
    wanted = sensor_keys(sensors, **kw)
    found = wanted.select("kind", "key").distinct().join(place_keys(forecast, locations), ["kind", "key"])
    matched = wanted.join(found.select("kind", "key").distinct(), ["kind", "key"])
    best = matched.groupBy("sensor_id").agg(F.min("rank").alias("rank"))
    return (
        matched.join(best, ["sensor_id", "rank"])
        .join(found, ["kind", "key"])
        .select("sensor_id", "rank", "device_id", "location_id")
        .distinct()
    )
