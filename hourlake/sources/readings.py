"""Sensor rows from a relational snapshot or Parquet, with lookback and column mapping."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.operators.ranking import keep_first


@dataclass(frozen=True)
class SourceMapping:
    """Names of the source columns."""

    device_id: str = "device_id"
    location_id: str = "location_id"
    province_id: str = "province_id"
    event_ts: str = "event_ts"
    temperature: str = "temperature"
    humidity: str = "humidity"

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(src).alias(dst) for dst, src in self.__dict__.items()])


def jdbc(spark: SparkSession, url: str, table: str, id_column: str, bounds: tuple[int, int], parts: int, **options):
    """Table scan split over the id range; filters and columns are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=id_column, lowerBound=bounds[0],
                 upperBound=bounds[1], numPartitions=parts, **options)
        .load()
    )


def read_readings(readings: DataFrame, devices: DataFrame, lookback_days: int, as_of: Column, source="database"):
    """Readings of the last days with ids taken from the row, else its device."""
    recent = readings.where(F.col("event_ts") >= as_of - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    one = keep_first(devices, ["source"], [F.col("id").asc()]).select(
        F.col("source").alias("_src"), F.col("location").alias("_loc"), F.col("province").alias("_prov")
    )
    j = recent.join(one, recent["sensor_id"] == one["_src"], "left")
    return j.select(
        F.coalesce(F.col("sensor_id"), F.col("device_id").cast("string")).alias("device_id"),
        F.coalesce("location_id", "_loc").alias("location_id"),
        F.coalesce("province_id", "_prov").alias("province_id"),
        "event_ts",
        "temperature",
        "humidity",
        F.lit(source).alias("source"),
    )


def read_since(df: DataFrame, marks: DataFrame, source: str = "source", ts: str = "event_ts") -> DataFrame:
    """Rows newer than the stored mark of their source; sources without a mark are read whole."""
    m = marks.select(F.col(source).alias("_s"), F.col("last_synced_event_ts").alias("_mark"))
    j = df.join(m, df[source] == m["_s"], "left")
    return j.where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).select(df.columns)


def next_marks(df: DataFrame, source: str = "source", ts: str = "event_ts") -> DataFrame:
    return df.groupBy(source).agg(F.max(ts).alias("last_synced_event_ts"))


def read_events(spark: SparkSession, fmt: str, schema, path: str | None = None, **options) -> DataFrame:
    """Event log as a stream: a Kafka topic (`value` as JSON text) or a folder of files."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        raw = reader.load()
        return raw.select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"),
            F.col("topic"), F.col("timestamp").alias("received_at"),
        )
    return reader.schema(schema).load(path)
