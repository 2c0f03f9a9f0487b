"""Table maintenance as pure functions (target, source) -> new target, plus Parquet writers."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema: missing columns as typed NULL, the rest cast, extras dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def has_columns(df: DataFrame, required) -> bool:
    return not set(required) - set(df.columns)


def evolve(df: DataFrame, new_fields: T.StructType) -> DataFrame:
    """Add the absent fields as typed NULLs; existing columns stay."""
    add = {f.name: F.lit(None).cast(f.dataType) for f in new_fields if f.name not in df.columns}
    return df.withColumns(add) if add else df


def _matches(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched keys take the source row, new keys are added. Source keys must be unique."""
    kept = target.alias("t").join(source.alias("s"), _null_safe(keys, "t", "s"), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def _null_safe(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def replace_where(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every target row whose keys occur in the source, then append the source."""
    gone = source.select(*keys).distinct()
    kept = target.alias("t").join(gone.alias("s"), _null_safe(keys, "t", "s"), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def update_where(df: DataFrame, cond: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in changes.items()})


def flag_matching(target, best, keys: dict[str, object], flag: str) -> DataFrame:
    """Set `flag` on rows whose keys (NULL replaced by the given default) occur in `best`."""
    fill = lambda k, d: F.col(k) if d is None else F.coalesce(F.col(k), F.lit(d))
    hit = best.select(*[fill(k, d).alias(f"_k_{k}") for k, d in keys.items()]).distinct()
    hit = hit.withColumn("_hit", F.lit(True))
    on = reduce(lambda a, b: a & b, [fill(k, d) == F.col(f"_k_{k}") for k, d in keys.items()])
    cols = target.columns
    joined = target.join(hit, on, "left")
    return joined.withColumn(flag, F.coalesce("_hit", flag, F.lit(False))).select(
        *cols if flag in cols else [*cols, flag]
    )


def retain(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than `days` at `as_of`."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def resolve_alerts(alerts: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Set resolved_at on the alerts whose id is in `done`."""
    hit = done.select(F.col("id").alias("_id")).distinct().withColumn("_done", F.lit(True))
    return (
        alerts.join(hit, alerts["id"] == F.col("_id"), "left")
        .withColumn("resolved_at", F.when(F.col("_done"), at).otherwise(F.col("resolved_at")))
        .drop("_id", "_done")
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """Parquet table; one shuffle on the partition columns keeps files few, AQE splits big ones."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in df."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def cluster(df: DataFrame, cols: list[str], files: int | None = None) -> DataFrame:
    """Range layout, so that row-group min/max can skip data."""
    ranged = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    return ranged.sortWithinPartitions(*cols)


def rank_limits(df: DataFrame, cols: list[str], bits: int, sample: int = 10_000) -> list[list]:
    """Up to 2^bits - 1 limits per column that cut it into even ranges, from `sample` rows at most."""
    picked = df.select(*cols).orderBy(F.rand(7)).limit(sample).collect()
    out = []
    for i in range(len(cols)):
        values = sorted(r[i] for r in picked if r[i] is not None)
        out.append(sorted({values[k * len(values) >> bits] for k in range(1, 1 << bits)}) if values else [])
    return out


def morton_key(df: DataFrame, cols: list[str], bits: int = 8) -> Column:
    """The bits of the columns' range ranks in turn: rows near in every column get near keys. NULL ranks lowest."""
    key = F.lit(0).cast("long")
    reached = lambda c: lambda v: v <= F.col(c)
    for i, (c, limits) in enumerate(zip(cols, rank_limits(df, cols, bits), strict=True)):
        if not limits:
            continue
        bounds = F.array(*[F.lit(v) for v in limits]).cast(f"array<{df.schema[c].dataType.simpleString()}>")
        rank = F.coalesce(F.size(F.filter(bounds, reached(c))), F.lit(0)).cast("long")
        for b in range(bits):
            key = key + F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + i)
    return key


def zorder(df: DataFrame, cols: list[str], files: int | None = None, bits: int = 8) -> DataFrame:
    """Z-order layout: a filter on any of the columns, not only the first, skips most row groups."""
    keyed = df.withColumn("_z", morton_key(df, cols, bits))
    ranged = keyed.repartitionByRange(files, "_z") if files else keyed.repartitionByRange("_z")
    return ranged.sortWithinPartitions("_z", *cols).drop("_z")


def zorder_write(df: DataFrame, cols: list[str], path: str, files: int | None = None, bits: int = 8) -> None:
    zorder(df, cols, files, bits).write.mode("overwrite").parquet(path)


def cluster_write(df: DataFrame, cols: list[str], path: str, files: int | None = None) -> None:
    cluster(df, cols, files).write.mode("overwrite").parquet(path)


def union_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def concat_dedupe(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Earlier parts win; inside a part the order decides."""
    from hourlake.operators.ranking import keep_first

    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return keep_first(union_rows(tagged), keys, [F.col("_part"), *order]).drop("_part")


def merge_tail(history: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Stored history plus the live tail; equal rows once."""
    return history.unionByName(live).select(*keys).distinct()


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_rows(
        [
            t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
            for n, t in tables.items()
        ]
    )


def rebuild_on_drift(lake: "Lake", name: str, df: DataFrame, required) -> bool:
    """Write `df` anew when the stored table is missing or lacks a required column; tells whether it did.

    A table that has all columns is left as it is.
    """
    drifted = not lake.exists(name) or not has_columns(lake.table(name), required)
    if drifted:
        lake.write(name, df)
    return drifted


class Lake:
    """Parquet tables under one root, by name."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str, default_schema: T.StructType | None = None) -> DataFrame:
        if self.exists(name):
            return self.spark.read.parquet(self.path(name))
        if default_schema is None:
            raise FileNotFoundError(f"table {name} does not exist under {self.root}")
        return self.spark.createDataFrame([], default_schema)

    def write(self, name: str, df: DataFrame, partition_by: list[str] = ()) -> None:
        write_table(df, self.path(name), partition_by)
