"""Small helpers that the operators share."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the folder that the cluster shares."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table: later steps read files, so a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def whole_rows(df: DataFrame, **extra) -> DataFrame:
    """The row as one struct `row`, beside computed columns: no column of the caller can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in extra.items()])


def back_to_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sorted_groups(batches, keys: list[str]):
    """Tables of whole groups, from batches sorted by the keys; many small groups come together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tail = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, tail, strict=True):
            same &= batch.column(k).to_numpy() == v.as_py()
        start = batch.num_rows - int(same.sum())  # the last group may go on in the next batch
        if start:
            yield pa.Table.from_batches([*kept, batch.slice(0, start)])
            kept = []
        elif kept and any(kept[-1].column(k)[0] != v for k, v in zip(keys, tail, strict=True)):
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin, and the end."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
