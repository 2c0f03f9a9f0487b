"""Edge rows of single functions and operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hourlake.functions import geo, measure, models, text, when
from hourlake.operators import evaluation, features, forecast, matching, quality, ranking, rollup, spacing, state, stations, tables
from hourlake.sources import payloads

T0 = dt.datetime(2024, 1, 1)


def one(df):
    return [tuple(r) for r in df.collect()]


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_quality_flag_edges(spark):
    cases = [
        (None, 20.0, 50.0, "invalid_timestamp"), (T0, -10.0, 0.0, "valid"), (T0, 60.0, 100.0, "valid"),
        (T0, -10.01, 50.0, "invalid_temperature"), (T0, 60.01, 50.0, "invalid_temperature"), (T0, None, None, "valid"),
        (T0, float("nan"), 50.0, "invalid_temperature"), (T0, 20.0, -0.1, "invalid_humidity"), (T0, 20.0, 100.1, "invalid_humidity"),
        (T0, 99.0, 999.0, "invalid_temperature"),
    ]
    df = quality.with_flag(rows(spark, cases, "event_ts timestamp, temperature double, humidity double, want string"))
    assert df.where("quality_flag <> want").count() == 0
    strict = quality.with_flag(rows(spark, [(T0, None, 1.0)], "event_ts timestamp, temperature double, humidity double"), strict_nulls=True)
    assert strict.first().quality_flag == "invalid_temperature"


def test_bad_text_becomes_null(spark):
    raw = rows(spark, [("d", "l", "p", "not a time", "abc", "5")],
               "device_id string, location_id string, province_id string, event_ts string, temperature string, humidity string")
    r = quality.project_raw(raw, F.lit(T0)).first()
    assert (r.event_ts, r.temperature, r.humidity) == (None, None, 5.0)


@pytest.mark.parametrize("n,want", [(720, 0.0), (900, 0.0), (360, 0.5)])
def test_missing_ratio(spark, n, want):
    assert spark.range(1).select(measure.missing_ratio(F.lit(n))).first()[0] == want


def test_parse_epoch_or_iso(spark):
    cases = [("1704067200", T0), ("1704067200000", T0), ("2024-01-01T00:00:00Z", T0), ("2024-01-01T07:00:00+07:00", T0),
             ("2024-01-01T00:00:00", T0), ("garbage", None), ("", None)]
    ts, ms = when.parse_epoch_or_iso(F.col("x"))
    got = rows(spark, cases, "x string, want timestamp").select(ts.alias("ts"), ms.alias("ms"), "want")
    assert got.where("NOT (ts <=> want)").count() == 0
    assert got.where("want IS NOT NULL AND ms <> 1704067200000").count() == 0


def test_relative_humidity(spark):
    f = lambda t, d: spark.range(1).select(measure.rh_from_dewpoint(F.lit(t).cast("double"), F.lit(d).cast("double"))).first()[0]
    a = lambda x: math.exp(17.625 * x / (243.04 + x))
    assert f(30, 20) == round(100 * a(20) / a(30), 1)
    assert f(20, 20) == 100.0 and f(20, 25) == 100.0 and f(None, 5) is None


def test_text_rules(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    assert s(text.slug(F.lit("Hồ Chí Minh"))) == "hochiminh"
    assert s(text.slug(F.lit("Đà Nẵng, Vietnam"))) == "anangvietnam"
    assert s(text.strip_accents(F.lit("Đà Nẵng"))) == "đa nang"
    assert s(text.text_variants(F.lit("Huế (city)"))) == ["huế (city)", "huế"]
    assert s(text.text_variants(F.lit(""))) == []
    for raw, want in (("Sensor-007", "sensor_7"), ("sensor7", "sensor_7"), ("SENSOR_0", "sensor_0"), (" esp32 ", "esp32")):
        assert s(text.norm_sensor_id(F.lit(raw))) == want


def test_distance(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    L = lambda x: F.lit(float(x))
    assert s(geo.haversine_km(L(10), L(10), L(10), L(10))) == 0.0
    assert abs(s(geo.haversine_km(L(0), L(0), L(0), L(180))) - math.pi * 6371) < 1e-6
    assert [s(geo.distance_bucket(L(d))) for d in (75, 150, 200, 201)] == [
        "near_station", "medium_distance_station", "far_station", "too_far_station"]
    assert s(geo.metres_fix(L(1500))) == 1.5


def test_quality_label_zero_rmse(spark):
    f = lambda r2, rmse, compat: spark.range(1).select(models.quality_label(F.lit(r2), F.lit(rmse), compat)["quality_label"]).first()[0]
    assert (f(0.85, 1.0, False), f(0.65, 1.0, False), f(0.1, 0.0, False), f(0.1, 0.0, True)) == ("excellent", "good", "usable", "weak")


def test_alias_null_is_not_absent(spark):
    m = rows(spark, [(1, '{"sensor_id":"a","temperature":null,"temp":5,"h":7}', "x"), (2, "[1]", "x"), (3, "", "x"),
                     (4, '{"metric_type":"pressure","value":"7.5"}', "sensors/s9/data"), (5, '{"temperature":"bad"}', "x")],
             "id int, payload string, topic string")
    got = {r.id: r for r in payloads.parse_sensor_json(m).collect()}
    assert set(got) == {1, 4}
    assert (got[1].temperature, got[1].humidity, got[1].sensor_id) == (None, 7.0, "a")
    assert (got[4].sensor_id, got[4].form, got[4].metric_value) == ("s9", "long", 7.5)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def alerts_df(spark, items):
    return rows(spark, [("s", "temperature", at(t), i, st) for i, (t, st) in enumerate(items)],
                "source string, metric_type string, event_ts timestamp, id int, status string")


def fired(df):
    return sorted(int((r.event_ts - T0).total_seconds()) for r in df.collect())


def test_cooldown(spark):
    cool = lambda items, **k: fired(spacing.apply_cooldown(alerts_df(spark, items), ["source", "metric_type"], "event_ts", "id", **k))
    c = "critical"
    assert cool([(0, c), (10, c), (70, c), (100, c), (140, c)]) == [0, 70, 140]
    assert cool([(0, c), (10, None), (20, c)]) == [0, 20]
    # the same across chunk borders
    for chunk in (60, 75, 90):
        assert cool([(0, c), (10, c), (70, c), (100, c), (140, c)], chunk_seconds=chunk) == [0, 70, 140]


def test_cooldown_equals_plain_fold(spark):
    import random

    rnd = random.Random(7)
    items = sorted(((rnd.randrange(0, 4000), rnd.choice(["critical", "warning", None, "critical"])) for _ in range(600)), key=lambda x: x[0])
    want, last = [], None
    for t, st in items:
        if st is None:
            last = None
        elif last is None or t - last >= 60:
            want.append(t)
            last = t
    for chunk in (60, 100, 700, 86_400):
        got = spacing.apply_cooldown(alerts_df(spark, items), ["source", "metric_type"], "event_ts", "id", chunk_seconds=chunk)
        assert fired(got) == want


def test_alert_on_change(spark):
    items = [(0, "warning"), (60, "critical"), (120, "critical"), (360, "critical"), (361, "critical"), (400, None), (420, "warning")]
    got = spacing.alert_on_change(alerts_df(spark, items), ["source", "metric_type"], "event_ts", "id")
    assert fired(got) == [0, 60, 361, 420]


def test_hysteresis(spark):
    hum = [70.0, 59.0, 65.0, 74.0, 75.0, 65.0]
    df = rows(spark, [("s", at(i), i, None, h) for i, h in enumerate(hum)],
              "sensor_id string, event_ts timestamp, id int, temperature double, humidity double")
    got = {r.id: r.fog for r in state.actuator_state(df).collect()}
    assert [got[i] for i in range(6)] == [False, True, True, True, False, False]


def test_stale_filter(spark):
    df = rows(spark, [("s", i, t) for i, t in enumerate([5, 5, 4, None, 6])], "source string, seq int, ts int")
    for seconds in (1, 2, 100):
        got = sorted(r.seq for r in state.drop_stale(df, "source", "seq", "ts", seconds=seconds).collect())
        assert got == [0, 3, 4]


@pytest.mark.parametrize("n,horizon", [(1, 5), (23, 5), (24, 5), (71, 5), (72, 5), (167, 5), (168, 400), (200, 168)])
def test_fallback_by_length(spark, n, horizon):
    import numpy as np

    values = [20.0 + math.sin(i) * 3 + i * 0.01 for i in range(n)]
    df = rows(spark, [("l", "d", at(3600 * i), v, None) for i, v in enumerate(values)],
              "location_id string, device_id string, hour_ts timestamp, temperature double, humidity double")
    every = forecast.fallback_forecast(df, ["location_id", "device_id"], horizon).orderBy("horizon_step").collect()
    got = [r for r in every if r.metric_type == "temperature"]
    assert len(got) == horizon
    # humidity has no value: a missing forecast for every step
    assert [(r.base_forecast_value, r.model_status) for r in every if r.metric_type == "humidity"] == [(None, "insufficient_data")] * horizon
    if n < 24:
        want, status = [values[-1]] * horizon, "insufficient_data"
    elif n >= 168:
        want, status = [values[-168:][i % 168] for i in range(horizon)], "fallback_naive"
    else:
        y = values[-72:]
        k, b = np.polyfit(range(len(y)), y, 1)
        want, status = [b + k * (len(y) + i) for i in range(horizon)], "fallback_trend"
    assert [r.model_status for r in got] == [status] * horizon
    assert max(abs(r.base_forecast_value - w) for r, w in zip(got, want)) < 1e-8


def test_upsert_is_idempotent(spark):
    t = rows(spark, [(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    s = rows(spark, [(2, "B"), (None, "N"), (3, "c")], "k int, v string")
    once = tables.upsert(t, s, ["k"])
    want = {(1, "a"), (2, "B"), (None, "N"), (3, "c")}
    assert set(one(once)) == want and once.count() == 4
    assert set(one(tables.upsert(once, s, ["k"]))) == want


def test_deep_recent_n_matches_plain_rank(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, id % 7, 0) AS k", "id AS ts")
    got = ranking.recent_n(df, ["k"], "ts", 2500).count()
    assert got == sum(min(2500, c["count"]) for c in df.groupBy("k").count().collect())


def test_split_refuses_small_and_flat(spark):
    small = spark.range(99).selectExpr("timestamp_seconds(id * 3600) AS hour_ts")
    with pytest.raises(ValueError):
        evaluation.split_by_time(small)
    flat = spark.range(100).selectExpr("timestamp_seconds(0) AS hour_ts")
    with pytest.raises(ValueError):
        evaluation.split_by_time(flat)
    train, test = evaluation.split_by_time(spark.range(100).selectExpr("timestamp_seconds(id * 3600) AS hour_ts"))
    assert train.count() + test.count() == 100 and train.count() == 79


def test_metrics_edges(spark):
    df = rows(spark, [(5.0, 6.0), (5.0, 4.0), (5.0, float("nan")), (None, 1.0)], "y double, p double")
    m = evaluation.regression_metrics(df, "y", "p").first()
    assert (m.n, m.mae, m.r2) == (2, 1.0, 0.0)
    assert evaluation.regression_metrics(rows(spark, [(0.0, 1.0)], "y double, p double"), "y", "p").first().mape is None


def test_null_device_is_a_series_of_its_own(spark):
    df = rows(spark, [("l", d, at(3600 * i), 1.0 * i, 1.0) for i in range(3) for d in (None, "a")],
              "location_id string, device_id string, hour_ts timestamp, temperature double, humidity double")
    got = features.add_lags(df, ["temperature"], (1,)).where("temp_lag_1 IS NULL")
    assert got.count() == 2


def test_threshold_edges(spark):
    s = lambda v, lo, hi: spark.range(1).select(measure.breach_status(F.lit(v), F.lit(lo).cast("double"), F.lit(hi).cast("double"))).first()[0]
    assert (s(10.0, 5, 10), s(10.1, 5, 10), s(4.9, 5, 10), s(99.0, None, 10)) == (None, "critical", "warning", None)


def test_nearest_obs_prefers_earlier_on_tie(spark):
    a = rows(spark, [(1, "p", at(5400))], "id int, place string, created_at timestamp")
    o = rows(spark, [("p", at(3600), 1.0), ("p", at(7200), 2.0), ("p", at(90_000), 3.0)], "place string, event_ts timestamp, v double")
    assert matching.nearest_obs(a, o, ["place"], values=["v"]).first().v == 1.0


def test_nearby_matches_brute_force_across_the_date_line(spark):
    loc = rows(spark, [("a", 10.0, 179.5), ("b", -60.0, -179.9), ("c", 21.0, 105.8)], "location_id string, latitude double, longitude double")
    st = rows(spark, [(i, 10.0 + (i % 9) * 0.7 - 3, (179.0 + (i % 13) * 0.3 + 180) % 360 - 180) for i in range(60)]
              + [(100 + i, -60.5 + i * 0.1, 178.5 + i * 0.2 if i < 7 else -180 + i * 0.2) for i in range(12)]
              + [(200 + i, 20.0 + i * 0.4, 105.0 + i * 0.3) for i in range(12)], "station_id int, latitude double, longitude double")
    got = {(r.location_id, r.station_id) for r in stations.nearby(loc, st, 250.0).collect()}
    both = loc.join(st.toDF("station_id", "la", "lo"))
    d = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    want = {(r.location_id, r.station_id) for r in both.where(d <= 250.0).collect()}
    assert got == want and len(want) > 10


def test_minute_last_keeps_last_non_null(spark):
    df = rows(spark, [("s", at(1), 1, 5.0, None), ("s", at(2), 2, None, 7.0), ("s", at(3), 3, 6.0, None)],
              "sensor_id string, event_ts timestamp, id int, temperature double, humidity double")
    r = rollup.minute_last(df, ["sensor_id"]).first()
    assert (r.temperature, r.humidity) == (6.0, 7.0)


def test_recursive_forecast_matches_a_step_by_step_loop(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from hourlake.plans import training

    n, H = 60, 3
    data = [("l", "d", "p", at(3600 * i), 20 + math.sin(i / 3) * 4, 50 + math.cos(i / 5) * 9, 19.0 + (i % 5), None) for i in range(n)]
    hist = rows(spark, data, "location_id string, device_id string, province_id string, hour_ts timestamp, temperature double, "
                             "humidity double, meteostat_temperature double, meteostat_humidity double")
    numeric = ["temperature", "humidity", "meteostat_temperature", "meteostat_humidity", "hour", "temp_lag_6", "temp_rolling_24", "humidity_lag_1"]
    base = features.add_targets(features.add_rolling(features.add_lags(hist, ["temperature", "humidity"]), ["temperature"]), ["temperature"], (1,))
    base = base.select("*", *when.calendar("hour_ts")).dropna(subset=["temp_target_1", "temp_lag_6"]).fillna(50.0, ["meteostat_humidity"])
    base = base.withColumn("hour", F.col("hour").cast("double"))
    model = Pipeline(stages=[*training.preprocess_stages(numeric), LinearRegression(featuresCol="features", labelCol="temp_target_1", regParam=0.1)]).fit(base)
    as_of = at(3600 * n)
    got = [r.base_forecast_value for r in training.recursive_forecast(model, hist, "temperature", H, F.lit(as_of)).orderBy("horizon_step").collect()]

    temp, hum = [r[4] for r in data], [r[5] for r in data]
    ahead = [r.base_forecast_value for r in forecast.fallback_forecast(hist, ["location_id"], H).where("metric_type = 'humidity'").orderBy("horizon_step").collect()]
    want = []
    for step in range(H):
        row = {"location_id": "l", "device_id": "d", "province_id": "p", "temperature": temp[-1], "humidity": hum[-1],
               "meteostat_temperature": data[-1][6], "meteostat_humidity": hum[-1], "hour": float((as_of.hour + 1 + step) % 24),
               "temp_lag_6": temp[-6], "temp_rolling_24": sum(temp[-24:]) / 24, "humidity_lag_1": hum[-1]}
        p = model.transform(spark.createDataFrame([row])).first().prediction
        want.append(p)
        temp.append(p)
        hum.append(ahead[step])
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-8


def test_recursive_forecast_keeps_series_without_a_metric(spark):
    """Series without humidity, without temperature, without either and without a province have all their rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from hourlake.plans import training

    n, H = 30, 2
    value = {"both": (1, 1), "dry": (1, None), "cold": (None, 1), "none": (None, None), "free": (1, 1)}
    data = [("l", d, None if d == "free" else "p", at(3600 * i), t and 20.0 + i % 7, h and 50.0 + i % 5, 19.0, None) for d, (t, h) in value.items() for i in range(n)]
    hist = rows(spark, data, "location_id string, device_id string, province_id string, hour_ts timestamp, temperature double, "
                             "humidity double, meteostat_temperature double, meteostat_humidity double")
    numeric = ["temperature", "humidity", "temp_lag_1", "temp_rolling_24"]
    base = hist.where("device_id = 'both'").withColumns({"temp_lag_1": F.col("temperature"), "temp_rolling_24": F.col("temperature"), "y": F.col("temperature")})
    model = Pipeline(stages=[*training.preprocess_stages(numeric), LinearRegression(labelCol="y", regParam=0.1)]).fit(base)
    got = training.recursive_forecast(model, hist, "temperature", H, F.lit(at(3600 * n))).collect()
    assert sorted((r.device_id, r.horizon_step) for r in got) == sorted((d, k) for d in value for k in (1, 2))
    state = {r.device_id: (r.model_status, r.base_forecast_value is None) for r in got}
    assert state == {"both": ("trained_spark_mllib", False), "free": ("trained_spark_mllib", False), "dry": ("insufficient_data", False),
                     "cold": ("insufficient_data", True), "none": ("insufficient_data", True)}
    want = {(r.device_id, r.horizon_step): r.base_forecast_value for r in forecast.fallback_forecast(hist, ["device_id"], H).where("metric_type = 'temperature'").collect()}
    assert all(r.base_forecast_value == want[r.device_id, r.horizon_step] for r in got if r.device_id in ("dry", "cold", "none"))


def test_leading_models_without_a_full_rank(spark):
    """The first n per target are those of the whole leaderboard, whatever the flags and ties."""
    import random

    from hourlake.operators import evaluation

    r = random.Random(4)
    rows = [(r.choice("th"), r.choice((None, None, True, False)) if k % 2 else None, r.choice((None, 1.0, 2.0, 3.0, 4.0)), r.choice((0.5, 1.0)), r.random(), "global", f"l{k}", f"m{k % 7}", "x", f"u{k}")
            for k in range(300)]
    schema = "target_variable string, is_best boolean, rmse double, mae double, r2 double, training_mode string, location_id string, model_name string, model_type string, model_uri string"
    metrics = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp('2024-01-01') AS created_at")
    for n in (1, 5, 40):
        want = evaluation.top_models(evaluation.leaderboard(metrics).drop("rank_order"), n)
        got = evaluation.top_models(evaluation.leading_models(metrics, n), n)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2 * n
