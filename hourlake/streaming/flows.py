"""Streaming flows. Stateful ones keep one small value per key, so state grows with
the number of sensors, not with the number of messages."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hourlake.functions import when
from hourlake.operators import matching, quality, rollup, tables
from hourlake.operators.spacing import NONE, _replay
from hourlake.operators.ranking import keep_first, newest
from hourlake.operators.state import FAN_ON, FOG_OFF, FOG_ON, LAMP_ON
from hourlake.session import cut_lineage, exists, remove
from hourlake.sources.payloads import parse_sensor_json

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WIDE_METRICS = {"temperature": "temperature_unit", "humidity": "humidity_unit"}


def decode(messages: DataFrame, as_of: Column) -> DataFrame:
    """Messages (id, payload, topic, ...) -> typed readings with an event time."""
    d = parse_sensor_json(messages)
    return d.withColumn("event_ts", when.to_local(F.col("event_time"), as_of))


def fan_out(decoded: DataFrame, devices: DataFrame, generic: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide readings, long metrics, rejected metrics) of decoded messages."""
    wide = matching.enrich_readings(
        quality.require_reading(decoded.where("form = 'wide'").drop("metric_type", "metric_value", "unit"), "sensor_id"),
        devices, generic,
    )
    ids = ["id", "sensor_id", "location", "event_ts"]
    long = rollup.to_long(wide, WIDE_METRICS, ids).unionByName(
        decoded.where("form = 'long'").select(*ids, "metric_type", "metric_value", "unit")
    )
    ok, bad = quality.validate_metrics(long)
    return wide, ok, bad


def ingest(messages: DataFrame, devices: DataFrame, generic: DataFrame, out: str, checkpoint: str, as_of: Column,
           trigger=None):
    """Decode, validate, enrich and write wide readings, long metrics and rejects per micro-batch.

    Each batch overwrites its own folder, so a retried batch leaves no doubles.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch, as_of).persist()
        try:
            for name, df in zip(("readings", "metrics", "rejected"), fan_out(decoded, devices, generic)):
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            decoded.unpersist()

    return start(messages, write, checkpoint, trigger)


def start(stream: DataFrame, write, checkpoint: str, trigger=None):
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def bronze_sink(out: str, at: Column):
    """foreachBatch writer: a micro-batch with its ingest time, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("ingested_at", at).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def keyed(stream: DataFrame, keys: list[str], processor: "InOrder", schema) -> DataFrame:
    """Rows that a processor makes of each key's rows, with its state in the session's RocksDB store.

    This state API has no other store, so the session is set to it unless its user has chosen one.
    """
    conf = stream.sparkSession.conf
    if "HDFSBacked" in conf.get(STORE):  # Spark's default
        conf.set(STORE, ROCKSDB)
    # with processing time Spark plans empty batches for ever, so only states that expire ask for it
    mode = "None" if processor.forget is None else "ProcessingTime"
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)


class InOrder(StatefulProcessor):
    """One value per key, and the rows of a micro-batch taken in order.

    Only the columns that decide are put together and sorted; frames go out one by one, as they
    came. What a key holds at once is its part of one micro-batch, which the source's rate limit
    bounds. The state of a key that is silent for `forget` seconds is dropped; it then begins anew.
    A stream that forgets ends on an `availableNow` trigger only where
    spark.sql.streaming.noDataMicroBatches.enabled is false.
    """

    state_schema: str

    def __init__(self, order: list[str], uses: list[str], forget: float | None):
        self.order, self.uses, self.forget = order, uses, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state_schema, None if self.forget is None else int(self.forget * 1000))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        narrow = pd.concat([f[list(dict.fromkeys([*self.order, *self.uses]))] for f in frames], ignore_index=True)
        done, state = self.step(narrow.sort_values(self.order), self.value.get() if self.value.exists() else None)
        self.value.update(state)
        done, at = done.sort_index(), 0
        for f in frames:
            out = self.emit(f, done.iloc[at : at + len(f)])
            at += len(f)
            if len(out):
                yield out

    def step(self, rows: pd.DataFrame, state: tuple | None):
        """What became of each row (by the index of `rows`), and the state after them."""
        raise NotImplementedError

    def emit(self, frame: pd.DataFrame, done) -> pd.DataFrame:
        return frame[done.to_numpy()]


def micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64").where(times.notna(), NONE)


class Fresh(InOrder):
    """Rows without a time, or newer than all before."""

    state_schema = "top bigint"

    def __init__(self, seq: str, ts: str, forget: float | None):
        super().__init__([seq], [ts], forget)
        self.ts = ts

    def step(self, rows, state):
        top = state[0] if state else NONE
        us = micros(rows[self.ts])
        before = us.cummax().shift(1, fill_value=NONE).clip(lower=top)
        return rows[self.ts].isna() | (us > before), (max(top, int(us.max())),)


class Spaced(InOrder):
    """Alerts at least so long after the last one that fired."""

    state_schema = "last bigint"

    def __init__(self, ts: str, tie: str, status: str, gap: int, forget: float | None):
        super().__init__([ts, tie], [status], forget)
        self.ts, self.status, self.gap = ts, status, gap

    def step(self, rows, state):
        kind = rows[self.status].notna().astype("int64").to_numpy()
        fired, last = _replay(micros(rows[self.ts]).to_numpy(), kind, state[0] if state else NONE, self.gap)
        done = np.zeros(len(rows), bool)
        done[fired] = True
        return pd.Series(done, index=rows.index), (int(last),)


class Switches(InOrder):
    """Mode and three switches after each row."""

    names = ["auto", "fan", "lamp", "fog"]
    state_schema = "auto boolean, fan boolean, lamp boolean, fog boolean"

    def __init__(self, ts: str, tie: str, forget: float | None):
        super().__init__([ts, tie], ["temperature", "humidity", "set_auto", "set_fan", "set_lamp", "set_fog"], forget)

    def step(self, rows, state):
        carry = dict(zip(self.names, state or (True, False, False, False)))

        def settle(event: pd.Series, initial: bool) -> pd.Series:
            return event.astype("boolean").ffill().fillna(initial).astype(bool)

        obj = lambda c: rows[c].astype("object").where(rows[c].notna(), None)
        auto = settle(obj("set_auto"), carry["auto"])
        t, h = rows["temperature"], rows["humidity"]
        blank = pd.Series([None] * len(rows), index=rows.index, dtype="object")
        events = {
            "fan": blank.mask(auto & t.notna(), t >= FAN_ON).mask(~auto, obj("set_fan")),
            "lamp": blank.mask(auto & t.notna(), t <= LAMP_ON).mask(~auto, obj("set_lamp")),
            "fog": blank.mask(auto & (h <= FOG_ON), True).mask(auto & (h >= FOG_OFF), False).mask(~auto, obj("set_fog")),
        }
        done = pd.DataFrame({"auto": auto, **{n: settle(e, carry[n]) for n, e in events.items()}})
        return done, tuple(bool(done[n].iloc[-1]) for n in self.names)

    def emit(self, frame, done):
        return frame.assign(**{n: done[n].to_numpy() for n in self.names})


def drop_stale_stream(stream: DataFrame, key: str, seq: str, ts: str, forget: float | None = None) -> DataFrame:
    """Stream twin of drop_stale: state = newest time seen per source."""
    return keyed(stream, [key], Fresh(seq, ts, forget), stream.schema)


def cooldown_stream(stream: DataFrame, keys: list[str], ts: str, tie: str, status: str = "status",
                    seconds: float = 60.0, forget: float | None = None) -> DataFrame:
    """Stream twin of apply_cooldown: state = time of the last fired alert."""
    return keyed(stream, keys, Spaced(ts, tie, status, int(round(seconds * 1e6)), forget), stream.schema)


def actuator_stream(stream: DataFrame, key: str, ts: str, tie: str, forget: float | None = None) -> DataFrame:
    """Stream twin of actuator_with_commands: state = mode and three switches."""
    schema = T.StructType(stream.schema.fields + [T.StructField(n, T.BooleanType()) for n in Switches.names])
    return keyed(stream, [key], Switches(ts, tie, forget), schema)


def _newest_buckets(every: DataFrame) -> DataFrame:
    """Rows of the last version of each bucket; other versions' files are not read."""
    last = every.groupBy("bucket").agg(F.max("version").alias("_v")).withColumnRenamed("bucket", "_b")
    return every.join(last, (F.col("bucket") == F.col("_b")) & (F.col("version") == F.col("_v"))).drop("_b", "_v")


def latest_state_sink(lake_path: str, keys: list[str], ts: str, ties: list[str], buckets: int = 64):
    """foreachBatch writer keeping the newest row per key, in buckets of keys.

    A batch writes new versions of the buckets its keys fall into; others stay as they are, so
    what is written follows the batch and not the table. A repeated batch writes its versions
    again from the ones before, so the outcome is the same. The version before stays for
    readers that have begun; older ones of the touched buckets are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = cut_lineage(keep_first(batch, keys, newest(ts, *ties)).withColumn("bucket", bucket))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        before = [v for v in versions(spark, lake_path) if v < batch_id]
        if before:
            every = spark.read.option("basePath", lake_path).parquet(*[f"{lake_path}/version={v}" for v in before])
            old = _newest_buckets(every.where(F.col("bucket").isin(touched)))
            new = keep_first(old.select(new.columns).unionByName(new), keys, newest(ts, *ties))
        new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{lake_path}/version={batch_id}")
        for b in touched:
            for v in [v for v in before if exists(spark, f"{lake_path}/version={v}/bucket={b}")][:-1]:
                remove(spark, f"{lake_path}/version={v}/bucket={b}")
        for v in before:
            if not exists(spark, f"{lake_path}/version={v}/bucket=*"):
                remove(spark, f"{lake_path}/version={v}")

    return write


def versions(spark, lake_path: str) -> list[int]:
    """Finished versions, oldest first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{lake_path}/version=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def newest_version(spark, lake_path: str) -> DataFrame:
    """The table as the last finished batch has left it."""
    every = spark.read.option("basePath", lake_path).parquet(*[f"{lake_path}/version={v}" for v in versions(spark, lake_path)])
    return _newest_buckets(every).drop("version", "bucket")
