"""Hourly weather files, dimensions and sync planning."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.functions import geo
from hourlake.operators.ranking import dedupe, keep_first, oldest

# fixed values: file column -> table column
HOURLY_NAMES = {
    "time": "event_ts",
    "temp": "temperature_c",
    "rhum": "relative_humidity",
    "prcp": "precipitation",
    "wspd": "wind_speed",
    "pres": "pressure",
}


def normalize_hourly(raw: DataFrame, locations: DataFrame, method: str = "station") -> DataFrame:
    """Rename and type hourly rows, add absent metrics as NULL, and attach place and provenance."""
    cols = [
        (F.col(src).cast("timestamp") if dst == "event_ts" else F.col(src).try_cast("double")).alias(dst)
        if src in raw.columns
        else F.lit(None).cast("double").alias(dst)
        for src, dst in HOURLY_NAMES.items()
    ]
    extra = [c for c in ("station_id", "station_name", "distance_km") if c in raw.columns]
    d = F.col("distance_km").cast("double") if "distance_km" in extra else F.lit(None).cast("double")
    rows = raw.select("location_id", *extra, *cols).where(F.col("event_ts").isNotNull())
    place = dedupe(locations, ["location_id"], oldest("province_id")).select("location_id", "province_id")
    return (
        rows.join(place, "location_id")
        .withColumn("year", F.year("event_ts"))
        .withColumn("month", F.month("event_ts"))
        .withColumn("fetch_method", F.lit(method))
        .withColumn("data_quality", geo.distance_bucket(d, F.lit(method)))
    )


def seed_dims(rows: DataFrame, location_set: str = "all") -> tuple[DataFrame, DataFrame]:
    """(provinces, locations) from one row per place; repeated ids once."""
    from hourlake.operators.quality import filter_location_set

    chosen = filter_location_set(rows, location_set)
    prov = dedupe(
        chosen.select("province_id", "province_name", "region"), ["province_id"], oldest("province_name", "region")
    ).withColumn("is_active", F.lit(True))
    loc = dedupe(
        chosen.select("location_id", "province_id", "location_name", "latitude", "longitude", "altitude"),
        ["location_id"], oldest("province_id", "location_name"),
    )
    return prov, loc


def limit_locations(df: DataFrame, n: int) -> DataFrame:
    """First n places by id; 0 keeps all."""
    return df.orderBy("location_id").limit(n) if n else df


def latest_status(status: DataFrame) -> DataFrame:
    """Newest status per (place, year), unfinished rows last."""
    return keep_first(
        status, ["location_id", "year"], [F.col("finished_at").desc_nulls_last(), F.col("status").asc_nulls_last()]
    )


def plan_sync(locations: DataFrame, years: list[int], status: DataFrame, mode: str = "new") -> DataFrame:
    """(location, year) pairs to fetch. Modes: new, retry_failed, overwrite."""
    pairs = locations.select("location_id").distinct().withColumn(
        "year", F.explode(F.array(*[F.lit(int(y)) for y in years]))
    )
    if mode == "overwrite":
        return pairs
    last = latest_status(status).select("location_id", "year", "status")
    if mode == "retry_failed":
        return pairs.join(last.where(F.col("status") == "failed"), ["location_id", "year"], "left_semi")
    return pairs.join(last.where(F.col("status") == "success"), ["location_id", "year"], "left_anti")


def read_hourly(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)
