"""What must not be cut: stations, rows of a place, events without key or time, series without values, micro-batches."""

import datetime

from pyspark.sql import functions as F

from hourlake.operators import features, forecast, rollup, spacing, stations, tables
from hourlake.plans import training
from hourlake.streaming import flows


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_a_good_station_behind_many_unfit_ones(spark):
    places = spark.createDataFrame([("loc", 10.0, 100.0)], "location_id string, latitude double, longitude double")
    rows = [(f"s{i:03d}", 10.0 + i * 0.001, 100.0, 2030 if i < 60 else 2000, 2040) for i in range(64)]
    every = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, start_year int, end_year int")
    obs = spark.createDataFrame([(r[0], 700, 2) for r in rows], "station_id string, row_count int, metric_count int")
    points = spark.createDataFrame([], "location_id string, point_rows int")
    found = stations.candidates(places, every, obs, 2024, 720)
    assert found.count() == 64
    chosen = stations.select_station(places, found, points, 720).first()
    assert (chosen.fetch_method, chosen.station_id) == ("station", "s060")
    few = stations.candidates(places, every, obs, 2024, 720, max_accepted=2)
    assert sorted(r.station_id for r in few.where("reason = 'accepted'").collect()) == ["s060", "s061"]


def test_cooldown_keeps_null_keys_and_rows_without_time(spark):
    rows = [(1, "a", at(0)), (2, "a", at(1)), (3, None, at(0)), (4, None, at(1)), (5, None, at(3000)), (6, "a", None), (7, "b", None)]
    events = spark.createDataFrame([(*r, "high") for r in rows], "id long, source string, ts timestamp, status string")
    fired = lambda **kw: sorted(r.id for r in spacing.apply_cooldown(events, ["source"], "ts", "id", **kw).collect())
    assert fired(seconds=3600) == [1, 3, 5, 6, 7]
    assert fired(seconds=3 * 86_400) == [1, 3, 6, 7]
    assert sorted(r.id for r in spacing.alert_on_change(events, ["source"], "ts", "id").collect()) == [1, 3, 5, 6, 7]


def test_series_without_values_are_forecast_as_missing(spark):
    rows = [("a", at(60 * k), float(k), None) for k in range(30)] + [("b", at(60 * k), None, None) for k in range(5)]
    history = spark.createDataFrame(rows, "device_id string, hour_ts timestamp, temperature double, humidity double")
    got = forecast.fallback_forecast(history, ["device_id"], 12)
    assert got.count() == 2 * 2 * 12
    empty = got.where("device_id = 'b' OR metric_type = 'humidity'")
    assert {(r.base_forecast_value, r.model_status) for r in empty.collect()} == {(None, "insufficient_data")}
    assert got.where("device_id = 'a' AND metric_type = 'temperature' AND base_forecast_value IS NULL").count() == 0


def test_a_place_is_split_by_rows_without_a_cap(spark):
    rows = [("p", f"d{k % 7}", at(60 * (k // 7)), float(k)) for k in range(700)] + [("q", "d", at(k), 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "location_id string, device_id string, hour_ts timestamp, y double")
    got = training.location_split(df, "y", [], 10).collect()
    assert len(got) == 700 and sum(r.is_test for r in got) == 140
    assert max((r.hour_ts, r.device_id) for r in got if not r.is_test) < min((r.hour_ts, r.device_id) for r in got if r.is_test)


def test_latest_state_over_several_batches(spark, tmp_path):
    schema = "sensor_id string, id long, event_ts timestamp, v double"
    rows = [(f"s{k % 5}", k, at((k * 37) % 400), float(k)) for k in range(60)]
    for k in range(4):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = flows.latest_state_sink(str(tmp_path / "t"), ["sensor_id"], "event_ts", ["id"])
    q = flows.start(stream.drop("part"), sink, str(tmp_path / "progress"))
    q.awaitTermination()
    versions = sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("version="))
    assert versions == ["version=2", "version=3"]
    want = {s: max((r[2], r[1]) for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    got = flows.newest_version(spark, str(tmp_path / "t"))
    assert {r.sensor_id: (r.event_ts, r.id) for r in got.collect()} == want
    assert got.agg(F.count("*")).first()[0] == 5


def test_spread_ranks_are_plain_ranks(spark):
    from hourlake.operators import ranking

    rows = [(("a", "b", None)[k % 7 // 3], (k * 7919) % 500 if k % 11 else None, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = ranking.spread_rank(df, ["k"], order).collect()
    assert sorted(map(str, got)) == sorted(map(str, ranking.with_rank(df, ["k"], order).collect()))


def test_zorder_skips_by_either_column(spark, tmp_path):
    """A filter on place or on time leaves most row groups unread, and no row is lost."""
    import pyarrow.parquet as pq

    rows = spark.range(40_000).selectExpr(
        "concat('loc_', lpad(cast(pmod(hash(id), 200) as string), 3, '0')) AS location_id", "timestamp_seconds(1700000000 + pmod(hash(id, 3), 8000000)) AS event_ts", "id")
    tables.zorder_write(rows, ["location_id", "event_ts"], str(tmp_path / "z"), files=64)
    assert spark.read.parquet(str(tmp_path / "z")).exceptAll(rows).isEmpty() and spark.read.parquet(str(tmp_path / "z")).count() == 40_000
    groups = []
    for f in sorted((tmp_path / "z").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(3)}
            groups.append(cols)
    place = sum(c["location_id"].min <= "loc_077" <= c["location_id"].max for c in groups)
    ids = spark.read.parquet(str(tmp_path / "z")).selectExpr("input_file_name() AS f", "event_ts").groupBy("f").agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"))
    when = ids.where("timestamp_seconds(1702000000) BETWEEN a AND b").count()
    assert len(groups) >= 40 and 0 < place <= len(groups) / 3 and 0 < when <= len(groups) / 3


def test_zorder_of_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert tables.zorder(empty, ["a", "b"]).count() == 0
    rows = spark.createDataFrame([(None, 1), ("x", None), (None, None), ("y", 2)], "a string, b int")
    assert sorted(map(str, tables.zorder(rows, ["a", "b"], files=2).collect())) == sorted(map(str, rows.collect()))


def test_latest_state_writes_touched_buckets_only(spark, tmp_path):
    """A batch of one key writes one bucket; the same batch again changes nothing."""
    path = str(tmp_path / "t")
    sink = flows.latest_state_sink(path, ["sensor_id"], "event_ts", ["id"])
    row = "concat('s', cast(id AS string)) AS sensor_id", "timestamp_seconds(id) AS event_ts", "id"
    sink(spark.range(500).selectExpr(*row), 0)
    one = spark.createDataFrame([("s7", 9_999)], "sensor_id string, id long").selectExpr("sensor_id", "timestamp_seconds(id) AS event_ts", "id")
    for _ in range(2):
        sink(one, 1)
        assert len(list((tmp_path / "t/version=1").glob("bucket=*"))) == 1
        got = {r.sensor_id: r.id for r in flows.newest_version(spark, path).collect()}
        assert len(got) == 500 and got["s7"] == 9_999 and got["s8"] == 8
    sink(spark.createDataFrame([("new", 1)], "sensor_id string, id long").selectExpr("sensor_id", "timestamp_seconds(id) AS event_ts", "id"), 2)
    sink(one.limit(0), 3)
    assert flows.newest_version(spark, path).count() == 501


def chart_sides(spark):
    """Keys that follow one series, the same one, two, one twice, none that exists; NULL keys and times; a matched time."""
    hours = "{0} string, {1} timestamp, {2} double, {3} double"
    members = [("a", "g"), ("b", "g"), ("c", "g"), ("c", "h"), ("d", "h"), ("d", "h"), ("e", "none"), ("f", None), (None, "g")]
    ahead = [("g", at(600), None, None), ("g", at(660), 1.0, 2.0), ("g", at(720), 2.0, None), ("h", at(660), None, 5.0), ("h", at(2160), 4.0, 6.0), (None, at(660), 9.0, 9.0)]
    seen = [("a", at(540), 7.0, None), ("a", at(540), None, 3.0), ("a", at(660), 8.0, 1.0), ("a", at(661), 8.5, 1.0), ("c", at(600), 5.0, None), ("d", at(30), 6.0, 6.0),
            ("x", at(660), 1.5, None), (None, at(660), 2.5, 2.5), ("b", None, 3.5, 3.5)]
    return (spark.createDataFrame(seen, hours.format("k", "event_ts", "temperature", "humidity")), spark.createDataFrame(ahead, hours.format("g", "forecast_ts", "temperature", "humidity")),
            spark.createDataFrame(members, "k string, g string"))


def charts(spark, grain):
    """Rows of the chart over shared series, and over forecasts copied to every key."""
    actual, ahead, members = chart_sides(spark)
    side = lambda f, **kw: sorted(map(str, rollup.chart_rollup(actual, f, ["k"], grain, "2024-01-01", "2024-01-03", 0, **kw).collect()))
    return side(ahead, members=members, by="g"), side(members.join(ahead, "g").drop("g"))


def test_hours_of_shared_series_are_those_of_copied_ones(spark):
    shared, copied = charts(spark, "hour")
    assert shared == copied


def test_days_of_shared_series_are_those_of_copied_ones(spark):
    shared, copied = charts(spark, "day")
    assert shared == copied and len(shared) == 6 * 3


def test_bridges_over_shared_series_are_those_over_copied_ones(spark):
    actual, ahead, members = chart_sides(spark)
    a = actual.withColumnRenamed("event_ts", "ts")
    f = ahead.select("g", F.col("forecast_ts").alias("ts"), F.col("temperature").alias("forecast_temperature"), F.col("humidity").alias("forecast_humidity"))
    plain = features.bridge(a.join(members.join(f, "g").drop("g"), ["k", "ts"], "full_outer"), ["k"], "ts")
    shared = features.bridge_beside(a, f, ["k"], "ts", members, "g")
    rows = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows(shared) == rows(plain) and sum(r.forecast_temperature_bridge for r in shared.collect()) >= 2


def test_copies_of_a_series_are_not_shuffled(spark):
    actual, ahead, members = chart_sides(spark)
    a, f = actual.withColumnRenamed("event_ts", "ts"), ahead.withColumnsRenamed({"forecast_ts": "ts", "temperature": "forecast_temperature", "humidity": "forecast_humidity"})
    charts = [rollup.chart_rollup(actual, ahead, ["k"], g, "2024-01-01", "2024-01-03", members=members, by="g") for g in ("hour", "day")]
    for df in (*charts, features.bridge_beside(a, f, ["k"], "ts", members, "g")):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        # from the join that copies a series to its keys on, rows are only filtered and picked; keys come dealt out by number
        assert "FullOuter" not in text and "RepartitionByExpression [_series" in text


def test_families_of_both_targets_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.regression import LinearRegression

    class Waits(LinearRegression):
        """Fits once four fits have begun."""

        begun = threading.Barrier(4)

        def fit(self, rows):
            self.begun.wait(60)
            return super().fit(rows)

    hour = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    df = spark.range(300).select(
        hour.alias("hour_ts"), *[F.lit(c).alias(c) for c in training.CATEGORICAL], *[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(training.NUMERIC)],
        *[(F.col("id") % (5 + i)).cast("double").alias(c) for i, c in enumerate(training.TARGETS.values())])
    df = spark.createDataFrame(df.collect(), df.schema)
    specs = lambda label, *_: {n: Waits(maxIter=5, regParam=reg, featuresCol="features", labelCol=label) for n, reg in (("x", 0.1), ("y", 0.2))}
    monkeypatch.setattr(training, "model_specs", specs)
    metrics, models = training.train_global(df, F.lit("2024-02-01").cast("timestamp"))
    assert sorted(models) == [(t, n) for t in sorted(training.TARGETS) for n in "xy"]
    assert [(r.model_name, r.target_variable) for r in metrics.where("status = 'trained'").sort("target_variable", "model_name").collect()] == [(n, t) for t in sorted(training.TARGETS) for n in "xy"]
