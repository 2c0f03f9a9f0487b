"""The model-driven forecast: choose a model per entity and metric, load it, roll it forward,
fall back where there is none, calibrate, and name the model in every row.

Models here are linear in the training inputs; a model is one row of coefficients, found by
its uri, so all entities of all models are forecast by one join and one narrow pass. A series
is one row with at most 168 values, and its steps are taken in order inside that pass.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions.models import default_ids, model_scope, model_status, run_id
from hourlake.operators import evaluation, forecast
from hourlake.operators.features import LAGS, ROLLING, SHORT
from hourlake.operators.tables import union_rows
from hourlake.plans.training import TARGETS, linear_prediction, location_coefficients, location_split

NAME, TYPE = "Spark Linear Regression", "spark_mllib"
#: Model inputs by target: the value itself, unless the caller names more of the training inputs.
OWN_VALUE = {m: [m] for m in TARGETS}


def linear_models(df: DataFrame, created_at: Column, run: str, inputs: dict[str, list[str]] = OWN_VALUE, min_rows: int = evaluation.MIN_ROWS,
                  ratio: float = 0.2, l2: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(metrics, models) of a global model and one per place, for every target.

    The global model is split from its test rows by time, a place's by row position. `models`
    holds model_uri and coefficients, intercept first; store it and hand it to `model_forecast`.
    """
    metrics, models = [], []
    for target, label in TARGETS.items():
        names = inputs[target]
        usable = default_ids(df).dropna(subset=[*names, label])
        everywhere = evaluation.mark_split(usable, "hour_ts", ratio).withColumn("location_id", F.lit("global")).drop("split_ts")
        parts = {"global": everywhere, "per_location": location_split(usable, label, names, min_rows, None, ratio)}
        for mode, rows in parts.items():
            w = location_coefficients(rows.where("NOT is_test"), label, names, l2)
            scored = rows.where("is_test").join(w, "location_id").withColumn("prediction", linear_prediction(names))
            m = evaluation.regression_metrics(scored, label, "prediction", ["location_id"])
            uri = F.concat_ws("/", F.lit(f"runs:/{run}"), F.lit(target), "location_id")
            place = F.when(F.col("location_id") != "global", F.col("location_id")) if mode == "per_location" else F.lit(None).cast("string")
            metrics.append(m.select(
                F.lit(NAME).alias("model_name"), F.lit(TYPE).alias("model_type"), F.lit(mode).alias("training_mode"), place.alias("location_id"),
                F.lit(target).alias("target_variable"), "mae", "rmse", "rse", "mape", "r2", F.col("n").alias("test_points"), uri.alias("model_uri"),
                F.lit(None).cast("boolean").alias("is_best"), created_at.alias("created_at"),
            ))
            models.append(w.select(uri.alias("model_uri"), "coefficients"))
    return union_rows(metrics), union_rows(models)


def _inputs(name: str, metric: str, values: np.ndarray, n: np.ndarray, other: np.ndarray, reference: dict[str, np.ndarray], hour: pd.Timestamp) -> np.ndarray:
    """One model input for all series at one hour; `values` ends with the newest one."""
    newest, mine = values[:, -1], SHORT[metric]
    if name == metric:
        return newest
    if name.startswith("meteostat_"):
        own = reference[name.removeprefix("meteostat_")]
        return np.where(np.isnan(own), newest if name.endswith(metric) else other, own)
    calendar = {"hour": (hour.hour, 24), "day_of_week": (hour.isoweekday() % 7 + 1, 7), "month": (hour.month, 12)}
    for part, (value, period) in calendar.items():
        angle = 2 * np.pi * value / period
        if name in (part, f"{part}_sin", f"{part}_cos"):
            return np.full(len(n), {part: value, f"{part}_sin": np.sin(angle), f"{part}_cos": np.cos(angle)}[name], float)
    for k in LAGS:
        if name == f"{mine}_lag_{k}":
            return np.where(n >= k, values[:, -k], newest)
    for k in ROLLING:
        if name == f"{mine}_rolling_{k}":
            return np.nanmean(values[:, -k:], axis=1)
    return other  # any input of the other metric follows its fallback


def rolled(state: DataFrame, inputs: dict[str, list[str]], horizon: int, as_of: Column) -> DataFrame:
    """`state` (key, metric_type, values, other, ref_temperature, ref_humidity, coefficients) with `path`, the predictions of all steps."""
    start = F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", as_of)))

    def run(batches):
        for pdf in batches:
            paths: list = [None] * len(pdf)
            for metric, part in pdf.groupby("metric_type"):
                at = pdf.index.get_indexer(part.index)
                n = part["values"].map(len).to_numpy()
                values = np.full((len(part), forecast.SEASON), np.nan)
                for i, v in enumerate(part["values"]):
                    values[i, forecast.SEASON - len(v):] = v
                others = np.array([list(x) if len(x) else [np.nan] * horizon for x in part["other"]], float)
                reference = {m: part[f"ref_{m}"].to_numpy(float) for m in SHORT}
                w, out = np.array(part["coefficients"].tolist(), float), np.empty((len(part), horizon))
                begin = part["start"].iloc[0]
                for step in range(horizon):
                    hour = begin + pd.Timedelta(hours=step)
                    x = [_inputs(name, metric, values, n, others[:, step], reference, hour) for name in inputs[metric]]
                    out[:, step] = w[:, 0] + sum(w[:, i + 1] * x[i] for i in range(len(x)))
                    values = np.hstack((values[:, 1:], out[:, step : step + 1]))
                    n = np.minimum(n + 1, forecast.SEASON)
                for i, path in zip(at, out.tolist(), strict=True):
                    paths[i] = path
            yield pdf[["key"]].assign(path=paths)

    return state.withColumn("start", start).mapInPandas(run, "key string, path array<double>")


def model_forecast(history: DataFrame, entities: DataFrame, joined: DataFrame, metrics: DataFrame, models: DataFrame, horizon: int, as_of: Column,
                   days: int, strategy: str = "global_best_type", inputs: dict[str, list[str]] = OWN_VALUE) -> DataFrame:
    """Calibrated rows of every entity, metric and step, from the chosen model or the fallback.

    A series with fewer than 24 values, or a model that is not among `models`, gives the
    fallback's rows and status. History is the device's own, else its place's.
    """
    keys = ["device_id", "location_id", "metric_type"]
    base = forecast.fallback_all(history, entities, joined, horizon, as_of, days)
    chosen = evaluation.choose_model(entities, metrics, strategy, (TYPE,)).join(models, "model_uri", "left")
    scoped = history.withColumn("scope", F.explode(F.array(F.col("device_id"), F.lit(None).cast("string"))))
    by = ["location_id", "scope"]
    tails = forecast.tails(scoped, by)
    reference = scoped.groupBy(*by).agg(*[
        F.max_by(f"meteostat_{m}", F.when(F.col(f"meteostat_{m}").isNotNull(), F.col("hour_ts"))).alias(f"ref_{m}") for m in SHORT])
    known = scoped.where("scope IS NOT NULL").select(F.col("location_id").alias("_l"), F.col("scope").alias("_s")).distinct()
    used = chosen.where("coefficients IS NOT NULL").join(known, (F.col("location_id") == F.col("_l")) & (F.col("device_id") == F.col("_s")), "left")
    used = used.select(*keys, F.col("_s").alias("scope"), "coefficients")
    same = lambda a, b: (F.col(f"{a}.location_id") == F.col(f"{b}.location_id")) & F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope"))
    long = tails.where(F.size("values") >= forecast.MINIMUM)
    state = used.alias("u").join(long.alias("t"), same("u", "t") & (F.col("u.metric_type") == F.col("t.metric_type"))).join(
        reference.alias("r"), same("u", "r")).select(*[f"u.{k}" for k in keys], "u.coefficients", "t.values", "r.ref_temperature", "r.ref_humidity")
    ahead = base.groupBy("device_id", "location_id", F.when(F.col("metric_type") == "temperature", "humidity").otherwise("temperature").alias("metric_type")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("horizon_step", "base_forecast_value"))), lambda x: x["base_forecast_value"]).alias("other"))
    state = state.join(ahead, keys).withColumn("key", F.to_json(F.struct(*keys)))
    paths = rolled(state, inputs, horizon, as_of).withColumn("k", F.from_json("key", "device_id string, location_id string, metric_type string"))
    steps = paths.select("k.*", F.posexplode("path").alias("_i", "_p")).select(*keys, (F.col("_i") + 1).alias("horizon_step"), "_p")
    j = base.join(steps, [*keys, "horizon_step"], "left").join(
        chosen.select(*keys, "model_name", "model_type", "training_mode", "model_location_id", "model_uri"), keys, "left")
    with_model = F.col("_p").isNotNull()
    value = F.when(with_model, F.col("_p")).otherwise(F.col("base_forecast_value"))
    named = lambda c, other: F.when(with_model, c).otherwise(F.lit(other))
    final = value + F.col("bias_value")
    return j.select(
        *keys, "province_id", "horizon_step", "forecast_timestamp", value.alias("base_forecast_value"), "bias_value", "sample_count",
        final.alias("forecast_value"), final.alias("calibrated_forecast_value"),
        named(F.col("model_name"), "fallback").alias("model_name"), named(F.col("model_type"), "baseline").alias("model_type"),
        named(model_scope(F.col("training_mode"), F.col("model_location_id"), F.col("location_id")), "fallback").alias("model_scope"),
        F.when(with_model, model_status(F.col("model_name"), F.col("model_type"))).otherwise(F.col("model_status")).alias("model_status"),
        F.when(with_model, F.col("model_uri")).alias("model_uri"), F.when(with_model, run_id(F.col("model_uri"))).alias("run_id"),
    )
