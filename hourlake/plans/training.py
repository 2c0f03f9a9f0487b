"""Training, evaluation and model forecasts as Spark jobs."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    FMRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from hourlake.functions.models import default_ids, model_status, quality_label
from hourlake.operators import evaluation, forecast
from hourlake.operators.features import SERIES, SHORT, numbered_rows, series_window
from hourlake.operators.ranking import keep_first
from hourlake.operators.tables import union_rows
from hourlake.plans.exported import export
from hourlake.session import exists

# fixed values: model inputs
VALUES = ["temperature", "humidity", "meteostat_temperature", "meteostat_humidity"]
CALENDAR = ["hour", "day_of_week", "month"]
CYCLIC = [f"{c}_{f}" for c in ("hour", "month", "day_of_week") for f in ("sin", "cos")]
LAGGED = [f"{s}_lag_{k}" for s in ("temp", "humidity") for k in (1, 6, 12, 24)]
ROLLED = [f"{s}_rolling_{n}" for s in ("temp", "humidity") for n in (24, 168)]
NUMERIC = [*VALUES, *CALENDAR, *CYCLIC, *LAGGED, *ROLLED]
CATEGORICAL = ["location_id", "province_id", "device_id"]
TARGETS = {"temperature": "temp_target_1", "humidity": "humidity_target_1"}
LOCATION_MIN_ROWS = 5000
REFIT_MIN_ROWS = 100
TAIL = 168


def preprocess_stages(numeric=NUMERIC, categorical=CATEGORICAL) -> list:
    """Index ids (unseen ones kept), fill gaps with medians, assemble, scale by deviation."""
    indexed = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    filled = [f"{c}_imputed" for c in numeric]
    return [
        *indexed,
        Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *[f"{c}_idx" for c in categorical]], outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True),
    ]


def model_specs(label: str, profile: str = "full", trees: int | None = None, bins: int = 64) -> dict:
    """Estimators by name. `trees` overrides the tree counts, `bins` must cover the distinct ids."""
    quick = profile == "quick"
    c = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    tree = {**c, "seed": 42, "maxBins": bins}
    out = {
        "Spark Linear Regression": LinearRegression(maxIter=60 if quick else 80, regParam=0.01, **c),
        "Spark Decision Tree": DecisionTreeRegressor(maxDepth=8 if quick else 10, minInstancesPerNode=2, **tree),
        "Spark Random Forest": RandomForestRegressor(
            numTrees=trees or (30 if quick else 120), maxDepth=8 if quick else 12, minInstancesPerNode=2, **tree),
    }
    if quick:
        return out
    return {
        **out,
        "Spark Generalized Linear Regression": GeneralizedLinearRegression(
            family="gaussian", link="identity", maxIter=80, regParam=0.01, **c),
        "Spark GBT": GBTRegressor(maxIter=trees or 120, maxDepth=6, stepSize=0.05, **tree),
        "Spark FM Regressor": FMRegressor(maxIter=80, stepSize=0.01, seed=42, **c),
        "Spark Linear Regression ElasticNet": LinearRegression(maxIter=80, regParam=0.05, elasticNetParam=0.5, **c),
    }


def estimator_for(name: str, label: str, bins: int = 64):
    """Light estimator of the family named in a metrics row; linear when nothing else fits."""
    c = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    tree = {**c, "seed": 42, "maxBins": bins}
    n = (name or "").lower()
    if "random forest" in n:
        return RandomForestRegressor(numTrees=30, maxDepth=8, **tree)
    if "decision tree" in n:
        return DecisionTreeRegressor(maxDepth=8, **tree)
    if "gbt" in n or "gradient" in n:
        return GBTRegressor(maxIter=30, maxDepth=5, **tree)
    return LinearRegression(maxIter=60, regParam=0.01, **c)


def training_frame(features: DataFrame) -> DataFrame:
    """Ids filled, model inputs as doubles."""
    targets = [t for t in TARGETS.values() if t in features.columns]
    return default_ids(features).withColumns({c: F.col(c).cast("double") for c in [*NUMERIC, *targets]})


def train_global(df: DataFrame, created_at: Column, targets: dict[str, str] = TARGETS, profile: str = "quick",
                 ratio: float = 0.2, final_refit: bool = False, trees: int | None = None, bins: int = 64, parallelism: int = 8):
    """Fit and score every model on every target, `parallelism` of them at a time.

    Returns (metrics, models): metrics rows with `is_best` on the winner by
    (rmse, mae, r2) of the run, and the fitted pipelines by (target, name).
    A family that cannot take the rows gets a row with status `unsuitable` and the
    reason; no model left is an error, and so is any other failure.
    """
    models, rows, kept, todo = {}, [], [], []

    def fit(target, label, name, estimator, prepared, train, test, n_train, usable, whole):
        try:
            fitted = estimator.fit(train)
            # one row per model comes back
            m = evaluation.regression_metrics(fitted.transform(test), label, "prediction").first()
            if final_refit:
                model = chained(whole, estimator.fit(whole.transform(usable).select("features", label)))
            else:
                model = chained(prepared, fitted)
        except IllegalArgumentException as e:  # this family cannot take these rows; anything else is an error
            return (name, "spark_mllib", "global", None, target, *[None] * 5, n_train, None, None, "unsuitable", str(e)[:300]), None
        return (name, "spark_mllib", "global", None, target, m["mae"], m["rmse"], m["rse"], m["mape"], m["r2"],
                n_train, m["n"], f"{target}/{name}", "trained", None), model

    try:
        for target, label in targets.items():
            usable = df.dropna(subset=[*NUMERIC, label])
            train, test = evaluation.split_by_time(usable, "hour_ts", ratio, exact=False)
            # the preparation is the same for every model: fit it once, keep only what models read
            prepared = Pipeline(stages=preprocess_stages()).fit(train)
            inputs = lambda d: prepared.transform(d).select("features", label)  # noqa: B023
            train, test = inputs(train).persist(), inputs(test).persist()
            kept += [train, test]
            whole = Pipeline(stages=preprocess_stages()).fit(usable) if final_refit else None
            n_train = train.count()
            todo += [(target, label, name, e, prepared, train, test, n_train, usable, whole)
                     for name, e in model_specs(label, profile, trees, bins).items()]
        # hourly rows are few and boosting is a chain of small jobs: models are fitted side by side
        run = inheritable_thread_target(df.sparkSession)(lambda x: (x[0], x[2], *fit(*x)))
        with ThreadPool(max(1, min(len(todo), parallelism))) as pool:
            for target, name, row, model in pool.map(run, todo, chunksize=1):
                rows.append(row)
                if model is not None:
                    models[target, name] = model
    finally:
        for d in kept:
            d.unpersist()
    for target in targets:
        if not any(t == target for t, _ in models):
            raise ValueError(f"no model could be trained for {target}")
    return finish_metrics(df.sparkSession.createDataFrame(rows, METRIC_ROWS), created_at), models


def chained(prepared: PipelineModel, model) -> PipelineModel:
    return PipelineModel(stages=[*prepared.stages, model])


METRIC_ROWS = (
    "model_name string, model_type string, training_mode string, location_id string, target_variable string, mae double, "
    "rmse double, rse double, mape double, r2 double, training_points bigint, test_points bigint, model_uri string, "
    "status string, reason string"
)


def finish_metrics(rows: DataFrame, created_at: Column) -> DataFrame:
    rows = rows.withColumn("created_at", created_at)
    q = quality_label(F.col("r2"), F.col("rmse"))
    rows = rows.withColumns({"quality_label": q["quality_label"], "confidence_score": q["confidence_score"]})
    best = evaluation.with_rank(rows, ["target_variable"], evaluation.best_order(), "_rank")
    return best.withColumn("is_best", (F.col("_rank") == 1) & F.col("rmse").isNotNull()).drop("_rank")


def location_split(df: DataFrame, label: str, features: list[str], min_rows: int, max_rows: int | None = None, ratio: float = 0.2):
    """Rows of places with enough of them, marked train or test in time order.

    All rows take part unless the caller sets `max_rows` (then a place's newest). Counts run
    over a place's days first, so rows are ranked within a day and no task holds a whole place.
    """
    usable = df.dropna(subset=[*features, label])
    usable = usable if max_rows is None else evaluation.recent_rows(usable, max_rows)
    usable = usable.withColumn("_day", F.to_date("hour_ts"))
    days = usable.groupBy("location_id", "_day").agg(F.count(F.lit(1)).alias("_m"))
    place = Window.partitionBy("location_id")
    days = days.withColumns({
        "_n": F.sum("_m").over(place),
        "_before": F.coalesce(F.sum("_m").over(place.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).where(F.col("_n") >= min_rows)
    order = Window.partitionBy("location_id", "_day").orderBy("hour_ts", "device_id")
    marked = usable.withColumn("_i", F.row_number().over(order)).join(days, ["location_id", "_day"])
    at = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(1.0 - evaluation.clamp_ratio(ratio))))
    return marked.withColumn("is_test", F.col("_before") + F.col("_i") > at).select(*df.columns, "is_test")


def location_coefficients(train: DataFrame, label: str, features: list[str], l2: float = 1e-3) -> DataFrame:
    """(location_id, coefficients): ridge regression of every place in one job, intercept first.

    Tasks reduce their rows to one small matrix per place; the matrices are added
    up cell by cell, and only the sums are solved.
    """
    p = len(features) + 1
    cols = [*features, label]

    def reduce_rows(batches):
        for pdf in batches:
            for place, g in pdf.groupby("location_id"):
                m = g[cols].to_numpy(dtype="float64")
                x = np.hstack([np.ones((len(m), 1)), m])
                yield pd.DataFrame({"location_id": [place], "cells": [(x.T @ x).ravel().tolist()]})

    def solve(key, pdf):
        m = pdf.sort_values("pos")["v"].to_numpy().reshape(p + 1, p + 1)
        a, b = m[:p, :p].copy(), m[:p, p]
        ridge = l2 * np.diag(a).copy()
        ridge[0] = 0.0
        w = np.linalg.lstsq(a + np.diag(ridge), b, rcond=None)[0]
        return pd.DataFrame({"location_id": [key[0]], "coefficients": [w.tolist()]})

    parts = train.select("location_id", *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        reduce_rows, "location_id string, cells array<double>"
    )
    sums = parts.select("location_id", F.posexplode("cells").alias("pos", "x")).groupBy("location_id", "pos").agg(F.sum("x").alias("v"))
    return sums.groupBy("location_id").applyInPandas(solve, "location_id string, coefficients array<double>")


def linear_prediction(features: list[str], coefficients: str = "coefficients") -> Column:
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    return F.aggregate(F.zip_with(x, F.col(coefficients), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def train_per_location(df: DataFrame, created_at: Column, targets: dict[str, str] = TARGETS, features=NUMERIC,
                       min_rows=LOCATION_MIN_ROWS, max_rows: int | None = None, ratio: float = 0.2):
    """(metrics, coefficients) of a ridge model per place and target. Rows carry is_best until ranked."""
    features = list(features)
    metrics, coefs = [], []
    for target, label in targets.items():
        rows = location_split(df, label, features, min_rows, max_rows, ratio)
        w = location_coefficients(rows.where(~F.col("is_test")), label, features)
        scored = rows.where("is_test").join(w, "location_id").withColumn("prediction", linear_prediction(features))
        m = evaluation.regression_metrics(scored, label, "prediction", ["location_id"])
        metrics.append(m.select(
            F.lit("Location Ridge").alias("model_name"), F.lit("spark_mllib").alias("model_type"),
            F.lit("per_location").alias("training_mode"), "location_id", F.lit(target).alias("target_variable"),
            "mae", "rmse", "rse", "mape", "r2", F.col("n").alias("test_points"),
            F.concat(F.lit(f"{target}/"), "location_id").alias("model_uri"), F.lit(True).alias("is_best"), created_at.alias("created_at"),
        ))
        coefs.append(w.withColumn("target_variable", F.lit(target)))
    return union_rows(metrics), union_rows(coefs)


def refit_local(df: DataFrame, location: str, label: str, model_name: str, bins: int = 64) -> PipelineModel:
    """Fit one place's own model when none can be loaded."""
    rows = default_ids(df.where(F.col("location_id") == location)).where(F.col(label).isNotNull())
    filled = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in NUMERIC]).first()
    if filled["n"] < REFIT_MIN_ROWS:
        raise ValueError(f"{location} has {filled['n']} rows, needs {REFIT_MIN_ROWS}")
    empty = {c: F.lit(0.0) for c in NUMERIC if not filled[c]}
    rows = rows.withColumns(empty) if empty else rows
    return Pipeline(stages=[*preprocess_stages(), estimator_for(model_name, label, bins)]).fit(rows)


def refit_places(df: DataFrame, label: str, features: list[str], min_rows: int = REFIT_MIN_ROWS, l2: float = 0.0) -> DataFrame:
    """(location_id, coefficients) of every place with enough labelled rows, in one job.

    Missing inputs count as 0, as an input without any value does in `refit_local`.
    """
    rows = default_ids(df).where(F.col(label).isNotNull()).fillna(0.0, features)
    enough = rows.groupBy("location_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select("location_id")
    return location_coefficients(rows.join(enough, "location_id", "left_semi"), label, features, l2)


def save_models(models: dict, root: str) -> dict:
    """Store fitted pipelines below `root`; their uris by (target, name), for `load_or_refit`."""
    uris = {}
    for (target, name), model in models.items():
        uris[target, name] = f"{root.rstrip('/')}/{target}/{name.replace(' ', '_')}"
        model.write().overwrite().save(uris[target, name])
    return uris


def load_or_refit(path: str | None, df: DataFrame, location: str, label: str, model_name: str, force_refit: bool = False):
    """Stored pipeline, or a local refit when it is missing or `force_refit` is set."""
    if path and not force_refit and exists(df.sparkSession, path):
        return PipelineModel.load(path)
    return refit_local(df, location, label, model_name)


def direct_forecast(model: PipelineModel, features: DataFrame, horizon: int) -> DataFrame:
    """An h-step label's model applied once to the newest row of each series."""
    last = keep_first(features, SERIES, [F.col("hour_ts").desc()])
    out = model.transform(last)
    return out.select(
        *SERIES, F.timestamp_seconds(F.unix_seconds("hour_ts") + horizon * 3600).alias("forecast_timestamp"),
        F.lit(horizon).alias("horizon_step"), "prediction",
    )


def step_inputs(names: list[str], tails: dict[str, np.ndarray], sizes: dict[str, np.ndarray], reference: dict[str, np.ndarray], hour: pd.Timestamp) -> np.ndarray:
    """Model inputs of all series at one hour, from value tails that end with the newest.

    Short tails use the newest value for a lag; what is still missing counts as 0 (the
    predictions of such series are not used).
    """
    out = {}
    for m, s in SHORT.items():
        tail, n = tails[m], sizes[m]
        newest = tail[:, -1]
        out[m] = newest
        out[f"meteostat_{m}"] = np.where(np.isnan(reference[m]), newest, reference[m])
        for k in (1, 6, 12, 24):
            out[f"{s}_lag_{k}"] = np.where(n >= k, tail[:, -k], newest)
        for k in (24, 168):
            out[f"{s}_rolling_{k}"] = np.nansum(tail[:, -k:], axis=1) / np.maximum(1, np.minimum(n, k))
    for part, value, period in (("hour", hour.hour, 24), ("day_of_week", hour.isoweekday() % 7 + 1, 7), ("month", hour.month, 12)):
        angle = 2 * np.pi * value / period
        rows = np.ones(len(newest))
        out[part], out[f"{part}_sin"], out[f"{part}_cos"] = rows * value, rows * np.sin(angle), rows * np.cos(angle)
    return np.nan_to_num(np.column_stack([out[c] for c in names]), nan=0.0)


def _tail_matrix(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most TAIL values as rows that end with the newest, and their lengths."""
    out, sizes = np.full((len(lists), TAIL), np.nan), np.zeros(len(lists), int)
    for i, values in enumerate(lists):
        sizes[i] = len(values)
        if len(values):
            out[i, TAIL - len(values):] = values
    return out, sizes


def recursive_forecast(model: PipelineModel, history: DataFrame, target: str, horizon: int, as_of: Column,
                       name: str = "Spark Linear Regression", model_type: str = "spark_mllib") -> DataFrame:
    """One-step model rolled forward for all series, in one narrow pass over series rows.

    The model (linear, trees or factors) goes along as arrays. The other metric advances by its
    fallback forecast. Series with under 24 values of either metric take their fallback
    throughout, NULL where they have no value of the target at all.
    """
    other = "humidity" if target == "temperature" else "temperature"
    keys = [*SERIES, "province_id"]
    hist = default_ids(history)
    tail = forecast.tails(hist, keys, TAIL)
    side = lambda m: tail.where(F.col("metric_type") == m).select(*keys, F.col("values").alias(f"_{m}"))
    ahead = forecast.fallback_forecast(hist, keys, horizon).groupBy(*keys, "metric_type").agg(
        F.sort_array(F.collect_list(F.struct("horizon_step", "base_forecast_value"))).alias("f"))
    path = lambda m, name: ahead.where(F.col("metric_type") == m).select(*keys, F.transform("f", lambda x: x["base_forecast_value"]).alias(name))
    ref = hist.groupBy(*keys).agg(*[
        F.max_by(f"meteostat_{m}", F.when(F.col(f"meteostat_{m}").isNotNull(), F.col("hour_ts"))).alias(f"_last_{m}") for m in SHORT])
    state = hist.select(*keys).distinct()
    for part in (side(target), side(other), path(target, "_own"), path(other, "_ahead"), ref):
        part = part.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        state = state.join(part, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
    start = F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", as_of)) + 3600)
    empty = F.array().cast("array<double>")
    state = state.withColumns({"_start": start, **{f"_{m}": F.coalesce(f"_{m}", empty) for m in (target, other)}})
    flat = export(model)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            tails, sizes = {}, {}
            for m in (target, other):
                tails[m], sizes[m] = _tail_matrix(pdf[f"_{m}"])
            enough = (sizes[target] >= forecast.MINIMUM) & (sizes[other] >= forecast.MINIMUM)
            own, aside = (np.array([np.asarray(x, float) if x is not None else np.full(horizon, np.nan) for x in pdf[c]]) for c in ("_own", "_ahead"))
            reference = {m: pdf[f"_last_{m}"].to_numpy(float) for m in SHORT}
            ids = np.column_stack([flat.indexed(c, pdf[c]) for c in flat.labels])
            begin, out = pdf["_start"].iloc[0], np.empty((len(pdf), horizon))
            for step in range(horizon):
                x = step_inputs(flat.numeric, tails, sizes, reference, begin + pd.Timedelta(hours=step))
                out[:, step] = np.where(enough, flat.predict(x, ids), own[:, step])
                for m, new in ((target, out[:, step]), (other, aside[:, step])):
                    tails[m] = np.hstack((tails[m][:, 1:], new[:, None]))
                    sizes[m] = np.minimum(sizes[m] + 1, TAIL)
            paths = [[None if np.isnan(v) else v for v in row] for row in out.tolist()]
            yield pdf[keys].assign(enough=enough, path=paths)

    schema = "location_id string, device_id string, province_id string, enough boolean, path array<double>"
    rolled = state.mapInPandas(run, schema).withColumn("_start", start)
    status = F.when(F.col("enough"), model_status(F.lit(name), F.lit(model_type))).otherwise("insufficient_data")
    return rolled.select(*keys, "_start", status.alias("model_status"), F.posexplode("path").alias("_i", "base_forecast_value")).select(
        *keys, F.lit(target).alias("metric_type"), (F.col("_i") + 1).alias("horizon_step"),
        F.timestamp_seconds(F.unix_seconds("_start") + F.col("_i") * 3600).alias("forecast_timestamp"), "base_forecast_value", "model_status",
    )


def sequence_stats(df: DataFrame, target: str, w: int, ratio: float = 0.2, floor: float = 1e-6, names=VALUES) -> DataFrame:
    """Mean and variance per input over all training windows, without building one.

    A row stands in as many training windows as there are training labels among the w rows
    after it: a difference of two running counts. Labels before the split time train.
    """
    rows = numbered_rows(df, target, w, names)
    split = evaluation.split_ts_exact(rows.where("is_label"), "hour_ts", ratio).scalar()
    rows = rows.withColumn("_before", F.sum((F.col("is_label") & (F.col("hour_ts") < split)).cast("long")).over(series_window()))
    along = series_window()
    times = F.coalesce(F.lead("_before", w).over(along), F.max("_before").over(Window.partitionBy(*SERIES))) - F.col("_before")
    weighted = rows.withColumn("_m", times).where("_m > 0").select("_m", F.posexplode("x").alias("_i", "_x"))
    x = F.col("_x").cast("double")
    sums = weighted.groupBy("_i").agg(F.sum("_m").alias("n"), F.sum(F.col("_m") * x).alias("s"), F.sum(F.col("_m") * x * x).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("feature"), mean.alias("mean"),
        F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(floor)).alias("variance"),
    )
