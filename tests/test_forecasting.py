"""Linear models rolled forward with all training inputs, against a plain loop over one series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourlake.operators.features import SHORT
from hourlake.plans import forecasting, training

START = datetime.datetime(2024, 3, 30, 21)


def plain(metric, names, tail, other, reference, w, horizon):
    values, out = list(tail), []
    o = "humidity" if metric == "temperature" else "temperature"
    for step in range(horizon):
        t = START + datetime.timedelta(hours=step)
        parts = {"hour": (t.hour, 24), "month": (t.month, 12), "day_of_week": (t.isoweekday() % 7 + 1, 7)}
        x = {metric: values[-1], o: other[step], f"meteostat_{metric}": reference[metric], f"meteostat_{o}": reference[o]}
        if x[f"meteostat_{metric}"] is None:
            x[f"meteostat_{metric}"] = values[-1]
        if x[f"meteostat_{o}"] is None:
            x[f"meteostat_{o}"] = other[step]
        for k, (v, period) in parts.items():
            x |= {k: v, f"{k}_sin": math.sin(2 * math.pi * v / period), f"{k}_cos": math.cos(2 * math.pi * v / period)}
        for k in (1, 6, 12, 24):
            x[f"{SHORT[metric]}_lag_{k}"] = values[-k] if len(values) >= k else values[-1]
        for k in (24, 168):
            x[f"{SHORT[metric]}_rolling_{k}"] = float(np.mean(values[-k:]))
        out.append(w[0] + sum(a * x.get(n, other[step]) for a, n in zip(w[1:], names, strict=True)))
        values.append(out[-1])
    return out


@pytest.mark.parametrize("metric", ["temperature", "humidity"])
def test_rolled_equals_a_loop(spark, metric):
    rng, names, horizon = np.random.default_rng(1), training.NUMERIC, 30
    rows, want = [], {}
    for i, n in enumerate((24, 100, 168)):
        tail, other = rng.uniform(10, 40, n).round(2).tolist(), rng.uniform(10, 40, horizon).round(2).tolist()
        reference = {"temperature": 20.5 if i else None, "humidity": 60.5 if i != 1 else None}
        w = [1.0, *(rng.uniform(-0.06, 0.06, len(names))).tolist()]
        rows.append((str(i), metric, tail, other, reference["temperature"], reference["humidity"], w))
        want[str(i)] = plain(metric, names, tail, other, reference, w, horizon)
    state = spark.createDataFrame(rows, "key string, metric_type string, values array<double>, other array<double>, ref_temperature double, ref_humidity double, coefficients array<double>")
    got = forecasting.rolled(state, {metric: names}, horizon, F.lit(START).cast("timestamp")).collect()
    for r in got:
        assert r.path == pytest.approx(want[r.key])


def test_saved_models_are_loaded(spark, tmp_path):
    """A stored pipeline predicts as before; a missing one is refitted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    names = ["location_id", "province_id", "device_id", "hour_ts", *training.NUMERIC, "temp_target_1"]
    rows = [("l", "p", "d", START + datetime.timedelta(hours=k), *rng.uniform(0, 9, len(training.NUMERIC) + 1).tolist()) for k in range(130)]
    df = spark.createDataFrame(rows, names)
    fitted = Pipeline(stages=[*training.preprocess_stages(), LinearRegression(featuresCol="features", labelCol="temp_target_1", regParam=0.01)]).fit(df)
    uris = training.save_models({("temperature", "Spark Linear Regression"): fitted}, str(tmp_path))
    shown = lambda m: [r.prediction for r in m.transform(df).orderBy("hour_ts").select("prediction").collect()]
    for path in (uris["temperature", "Spark Linear Regression"], str(tmp_path / "none")):
        again = training.load_or_refit(path, df, "l", "temp_target_1", "Spark Linear Regression")
        assert shown(again) == pytest.approx(shown(fitted), abs=1e-6 if path.endswith("n") else 0.5)


FAMILIES = ["Spark Linear Regression", "Spark Decision Tree", "Spark Random Forest", "Spark GBT", "Spark FM Regressor", "Spark Generalized Linear Regression"]


@pytest.fixture(scope="module")
def trained(spark):
    """A training table with gaps, of two series."""
    rng = np.random.default_rng(4)
    names = ["location_id", "province_id", "device_id", "hour_ts", *training.NUMERIC, "temp_target_1", "humidity_target_1"]
    rows = []
    for k in range(260):
        x = rng.uniform(0, 30, len(training.NUMERIC) + 2).round(2).tolist()
        if k % 11 == 0:
            x[3] = None
        x[-2] = round(0.7 * x[0] + 0.1 * x[5] + (4 if x[9] > 12 else 0), 3)
        rows.append((f"l{k % 2}", "p", None if k % 7 == 0 else f"d{k % 2}", START + datetime.timedelta(hours=k), *x))
    return spark.createDataFrame(rows, names[:4] + names[4:]).coalesce(1)


@pytest.mark.parametrize("name", FAMILIES)
def test_exported_models_predict_as_transform_does(trained, name):
    from pyspark.ml import Pipeline

    from hourlake.plans.exported import export

    label = "temp_target_1"
    est = training.model_specs(label, "full", trees=4)[name]
    fitted = Pipeline(stages=[*training.preprocess_stages(), est]).fit(trained)
    out = fitted.transform(trained).toPandas()
    flat = export(fitted)
    ids = np.column_stack([flat.indexed(c, out[c]) for c in flat.labels])
    got = flat.predict(out[flat.numeric].to_numpy(float), ids)
    assert got == pytest.approx(out["prediction"].to_numpy(), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("name", ["Spark Linear Regression", "Spark Random Forest"])
def test_recursive_forecast_equals_transform_step_by_step(spark, trained, name):
    from pyspark.ml import Pipeline

    label, target, other, horizon = "temp_target_1", "temperature", "humidity", 4
    fitted = Pipeline(stages=[*training.preprocess_stages(), training.model_specs(label, "quick", trees=4)[name]]).fit(trained)
    rng = np.random.default_rng(6)
    history, want = [], {}
    for d, n in (("d0", 40), ("d1", 200), ("d2", 10)):
        for k in range(n):
            t, h = rng.uniform(10, 30, 2).round(2).tolist()
            history.append(("l0", "p", d, START - datetime.timedelta(hours=n - 1 - k), t, h, 20.5 if d == "d0" else None, h))
    df = spark.createDataFrame(history, "location_id string, province_id string, device_id string, hour_ts timestamp, temperature double, humidity double, meteostat_temperature double, meteostat_humidity double")
    got = training.recursive_forecast(fitted, df, target, horizon, F.lit(START).cast("timestamp"), name).collect()
    ahead = {(r.device_id, r.metric_type, r.horizon_step): r.base_forecast_value for r in training.forecast.fallback_forecast(df, ["device_id"], horizon).collect()}
    for d in ("d0", "d1", "d2"):
        mine = [r for r in history if r[2] == d]
        tails = {target: [r[4] for r in mine], other: [r[5] for r in mine]}
        for step in range(1, horizon + 1):
            if d == "d2":  # too short: the fallback
                want[d, step] = ahead[d, target, step]
                continue
            hour = START + datetime.timedelta(hours=step)
            x = {target: tails[target][-1], other: tails[other][-1], "meteostat_temperature": 20.5 if d == "d0" else tails[target][-1], "meteostat_humidity": mine[-1][7]}
            for m, s in SHORT.items():
                for k in (1, 6, 12, 24):
                    x[f"{s}_lag_{k}"] = tails[m][-k]
                for k in (24, 168):
                    x[f"{s}_rolling_{k}"] = float(np.mean(tails[m][-k:]))
            for c, (v, period) in {"hour": (hour.hour, 24), "month": (hour.month, 12), "day_of_week": (hour.isoweekday() % 7 + 1, 7)}.items():
                x |= {c: float(v), f"{c}_sin": math.sin(2 * math.pi * v / period), f"{c}_cos": math.cos(2 * math.pi * v / period)}
            row = spark.createDataFrame([("l0", "p", d, *[float(x[c]) for c in training.NUMERIC])], ["location_id", "province_id", "device_id", *training.NUMERIC])
            p = fitted.transform(row).first().prediction
            want[d, step] = p
            tails[target].append(p)
            tails[other].append(ahead[d, other, step])
    assert {(r.device_id, r.horizon_step): r.base_forecast_value for r in got} == pytest.approx(want)
    status = {r.device_id: r.model_status for r in got}
    assert status["d2"] == "insufficient_data" and status["d0"] == ("trained_random_forest" if "Forest" in name else "trained_spark_mllib")


def test_sequence_roll_equals_a_loop(spark):
    """Weights on every cell of the window; predictions enter the value and its reference."""
    from hourlake.plans import sequences

    rng, window, horizon = np.random.default_rng(9), 5, 12
    rows, want = [], {}
    for d in ("a", "b"):
        x = rng.uniform(0, 5, (window, 4))
        for metric, own in (("temperature", 0), ("humidity", 1)):
            w, b, seq = rng.uniform(-0.1, 0.1, (window, 4)), 0.5, [r.copy() for r in x]
            for _ in range(horizon):
                p = b + float((np.array(seq[-window:]) * w).sum())
                new = seq[-1].copy()
                new[own] = new[own + 2] = p
                seq.append(new)
                want.setdefault((d, metric), []).append(p)
            rows.append(("l", d, metric, x.tolist(), b, w.ravel().tolist()))
    state = spark.createDataFrame(rows, "location_id string, device_id string, metric_type string, sequence array<array<double>>, intercept double, weights array<double>")
    got = {(r.device_id, r.metric_type): r.path for r in sequences.rolled(state, horizon, window).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_place_trees_split_where_the_values_do(spark):
    """Each place finds its own step; the prediction follows node by node; ids of unseen places have none."""
    from hourlake.plans import places

    rows = [(p, float(i % 50), float(i % 7), 10.0 if i % 50 >= (20 if p == "a" else 35) else -3.0) for p in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "location_id string, u double, v double, y double")
    for kind in ("tree", "forest"):
        model = places.fitted(df, "y", ["u", "v"], kind, trees=3, depth=3)
        out = df.join(model, "location_id").withColumn("p", places.prediction(["u", "v"], 3))
        wrong = out.selectExpr("avg(abs(p - y))").first()[0]
        assert wrong < (1e-9 if kind == "tree" else 3.0)


def test_loaded_refitted_and_short_places(spark):
    from hourlake.plans import places

    rows = [(p, float(i), 2.0 * i + (1 if p == "x" else 5)) for p, n in (("x", 120), ("y", 120), ("z", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "location_id string, u double, y double")
    chosen = spark.createDataFrame([(p, "Spark Linear Regression", f"runs:/r/{p}") for p in "xyz"], "location_id string, model_name string, model_uri string")
    models = spark.createDataFrame([("runs:/r/x", [7.0, 0.0], None)], f"model_uri string, coefficients array<double>, nodes {places.NODES}")
    got = {r.location_id: r for r in places.load_or_refit_places(df, chosen, models, "y", ["u"], l2=0.0).collect()}
    assert [got[p].origin for p in "xyz"] == ["loaded", "refitted", "insufficient_data"]
    assert got["x"].coefficients == [7.0, 0.0] and got["y"].coefficients == pytest.approx([5.0, 2.0]) and got["z"].coefficients is None
    forced = {r.location_id: r for r in places.load_or_refit_places(df, chosen, models, "y", ["u"], force=True, l2=0.0).collect()}
    assert forced["x"].origin == "refitted" and forced["x"].coefficients == pytest.approx([1.0, 2.0])


def test_windows_are_cut_from_chunks(spark):
    """Any chunk size gives the same windows; rows are stored about once."""
    from hourlake.operators import features

    rows = [("l", d, START + datetime.timedelta(hours=k), float(k), None if k % 17 == 3 else float(-k), 1.0, 2.0) for d, n in (("a", 90), ("b", 11), ("c", 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "location_id string, device_id string, hour_ts timestamp, temperature double, humidity double, meteostat_temperature double, meteostat_humidity double")
    show = lambda c: sorted((r.device_id, r.hour_ts, str(r.sequence), r.label) for r in features.sequence_windows(df, "temperature", 10, 3, chunk=c).collect())
    want = []
    for d in "abc":
        good = [r for r in rows if r[1] == d and r[4] is not None]
        want += [(d, good[k][2], str([[x for x in r[3:]] for r in good[k - 10 : k]]), good[k][3]) for k in range(10, len(good), 3)]
    assert show(10) == show(1024) == sorted(want)
    stored = features.sequence_chunks(df, "temperature", 10, chunk=40).selectExpr("sum(size(rows))").first()[0]
    assert stored <= 1.3 * len(rows)
