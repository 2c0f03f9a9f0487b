"""Session helpers: UTC time, AQE, and where checkpoints go."""

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "hourlake", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Sets the session's time zone to UTC, for the whole session: every catalog query calls this.

    Times are kept as UTC instants and shown to DuckDB without a zone; in another zone hours
    and days would be cut at other instants. Callers who need their own zone use the operators.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed.

    Python stages import it by name. Called once after the session has started; the zip is
    built on the driver and handed over by Spark.
    """
    import importlib.util
    import os
    import shutil

    top = os.path.dirname(os.path.abspath(importlib.util.find_spec("hourlake").origin))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="hourlake-zip-"), "hourlake"), "zip", os.path.dirname(top), "hourlake")
    spark.sparkContext.addPyFile(made)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else (local runs) a new one.

    A folder on one machine is never chosen for a real cluster: its files would
    be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="hourlake-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path (which may have wildcards) names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def input_version(spark: SparkSession, folder: str) -> str:
    """A digest of names, sizes and times of the tables' files in a folder."""
    import hashlib

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for p in ("*.parquet", "*.parquet/*.parquet") for f in store.globStatus(path(f"{folder}/{p}"))]
    lines = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@cache
def code_version() -> str:
    """A digest of the library's sources: tables made by other code are not taken for its own."""
    import hashlib
    import pathlib

    top = pathlib.Path(__file__).parent
    own = sorted(f for f in top.rglob("*.py") if f.relative_to(top).parts[0] != "llm")
    return hashlib.md5(b"".join(f.read_bytes() for f in own)).hexdigest()[:12]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
