"""Streams over several micro-batches: state is carried, and every result equals its batch form."""

import os
import subprocess
import sys
import time

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import TABLES, normal

DIR = "/root/testdata/sf0.001"
STREAMS = ["x1_ingest_stream", "x2_drop_stale_stream", "x4_apply_cooldown_stream", "x7_actuator_stream", "x8_latest_state_stream", "x13_hourly_rollup_stream"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """The tables, with the events cut by time into four files that arrive in order."""
    top = tmp_path_factory.mktemp("cut")
    for t in TABLES:
        if t != "events":
            (top / f"{t}.parquet").symlink_to(f"{DIR}/{t}.parquet")
    (top / "events.parquet").mkdir()
    c = duckdb.connect()
    for k in range(4):
        out = top / f"events.parquet/part-{k}.parquet"
        c.execute(f"COPY (SELECT * FROM '{DIR}/events.parquet' WHERE event_id >= {250 * k} AND event_id < {250 * (k + 1)} ORDER BY event_id) TO '{out}'")
        os.utime(out, (1_700_000_000 + 60 * k,) * 2)
    return str(top)


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_four_batches(spark, cut, name):
    df = entry.queries()[name](spark, cut)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, want.fetchall())


def test_a_late_row_is_dropped(spark, tmp_path):
    """A reading older than the watermark does not reopen its hour."""
    from hourlake.operators import rollup

    schema = "device_id string, location_id string, province_id string, event_ts timestamp, temperature double, humidity double, quality_flag string"
    files = [[("d", "2024-01-01 00:10:00", 10.0)], [("d", "2024-01-01 06:00:00", 20.0)], [("d", "2024-01-01 06:30:00", 22.0)], [("d", "2024-01-01 00:20:00", 99.0)], [("d", "2024-01-01 12:00:00", 30.0)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(d, "l", "p", t, v) for d, t, v in rows], "device_id string, location_id string, province_id string, t string, temperature double").selectExpr(
            "device_id", "location_id", "province_id", "timestamp(t) AS event_ts", "temperature", "double(null) AS humidity", "'valid' AS quality_flag"
        ).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        for f in (tmp_path / f"in/part={k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    q = rollup.hourly_rollup_stream(stream, "2 hours").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r.hour_ts): r.temperature_avg for r in spark.table("late").collect()}
    assert got == {"2024-01-01 00:00:00": 10.0, "2024-01-01 06:00:00": 21.0}


def test_silent_sensors_are_forgotten(spark, tmp_path):
    """A source's newest time is kept over batches, and dropped when it has been silent for `forget` seconds."""
    from hourlake.streaming import flows

    def arrive(k, rows):
        spark.createDataFrame(rows, "source string, seq int, t string").selectExpr("source", "seq", "timestamp(t) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{k}"))

    def run(name, forget, k):
        stream = spark.readStream.schema("source string, seq int, ts timestamp").parquet(str(tmp_path / f"in-{k}"))
        q = flows.drop_stale_stream(stream, "source", "seq", "ts", forget).writeStream.format("parquet").option("path", str(tmp_path / name))
        q.option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / name)).collect())

    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(empty, "false")
    arrive("a", [("s", 1, "2024-01-01 10:00:00"), ("s", 2, "2024-01-01 09:00:00"), ("s", 3, None)])
    assert run("kept", None, "a") == run("short", 0.5, "a") == [1, 3]
    time.sleep(1)
    arrive("a", [("s", 4, "2024-01-01 09:30:00"), ("s", 5, "2024-01-01 09:30:00"), ("s", 6, "2024-01-01 11:00:00")])
    assert run("kept", None, "a") == [1, 3, 6]
    assert run("short", 0.5, "a") == [1, 3, 4, 6]
    spark.conf.unset(empty)


def test_python_stages_run_from_another_folder(tmp_path):
    """The driver finds the package on its path only; the workers get it by ship_package."""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys
sys.path.insert(0, {top!r})
from hourlake.session import get_session, ship_package
from hourlake.operators import spacing
spark = get_session("away", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": 1}})
ship_package(spark)
sys.path.remove({top!r})
df = spark.createDataFrame([(1, "a", 0, "high"), (2, "a", 1, "high")], "id int, k string, s int, status string").selectExpr("*", "timestamp_seconds(s) AS ts")
assert spacing.apply_cooldown(df, ["k"], "ts", "id").count() == 1
where = spark.range(1).mapInPandas(lambda b: (x.assign(id=[__import__("hourlake").__file__] * len(x)) for x in b), "id string").first().id
assert ".zip" in where, where
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]


@pytest.mark.parametrize(("master", "one"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[1,1,1024]", False), ("spark://host:7077", False)])
def test_only_local_masters_get_a_local_folder(master, one):
    """A folder of one machine is never chosen where executors run elsewhere."""
    from types import SimpleNamespace

    from hourlake.session import shared_dir

    kept = {}
    conf = SimpleNamespace(get=lambda k, d: kept.get(k, d), set=kept.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if one:
        assert shared_dir(session) == kept["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError):
            shared_dir(session)
