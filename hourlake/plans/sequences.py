"""Sequence forecasts: a model reads the last rows of a series and feeds on its own predictions."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.functions.models import default_ids, model_status
from hourlake.operators import forecast
from hourlake.operators.features import INPUTS, SERIES, series_window
from hourlake.operators.ranking import keep_first

WINDOW = 168
#: Places of a target's own value and of its reference value in a row of inputs.
PLACES = {"temperature": (0, 2), "humidity": (1, 3)}


def complete(history: DataFrame, cols=INPUTS) -> DataFrame:
    """Gaps filled by the value before, else the one after; rows still incomplete are dropped."""
    w = series_window()
    before, after = (w.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    real = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    filled = {c: F.coalesce(F.last(v, ignorenulls=True).over(before), F.first(v, ignorenulls=True).over(after)) for c, v in real.items()}
    return history.withColumns(filled).dropna(subset=list(cols))


def seasonal_maps(history: DataFrame, window: int = WINDOW, season: int = 24) -> DataFrame:
    """(metric_type, intercept, weights): a least-squares line in the mean of value and reference one season ago, as a map of the whole window."""
    rows, w, out = complete(default_ids(history)), series_window(), None
    for metric, (own, reference) in PLACES.items():
        ago = (F.lag(INPUTS[own], season).over(w) + F.lag(INPUTS[reference], season).over(w)) / 2
        line = rows.select(F.col(metric).alias("y"), ago.alias("x")).agg(F.regr_intercept("y", "x").alias("intercept"), F.regr_slope("y", "x").alias("slope"))
        width = len(INPUTS)
        used = [(window - season) * width + c for c in (own, reference)]
        weights = F.transform(F.sequence(F.lit(0), F.lit(window * width - 1)), lambda i: F.when(i.isin(used), F.col("slope") / 2).otherwise(0.0))
        line = line.select(F.lit(metric).alias("metric_type"), "intercept", weights.alias("weights"))
        out = line if out is None else out.unionByName(line)
    return out


def rolled(state: DataFrame, horizon: int, window: int) -> DataFrame:
    """`path` of every row of state (series, metric_type, sequence, intercept, weights).

    The rows of a window lie in a ring: the newest prediction takes the place of the oldest
    row, and the weights are turned instead of the rows. A prediction enters both the value and
    the reference column of its target; the other inputs stay as they were last.
    """
    keys = [*SERIES, "metric_type"]

    def run(batches):
        for pdf in batches:
            for metric, part in pdf.groupby("metric_type"):
                ring = np.array([[list(r) for r in s] for s in part["sequence"]], float)
                weights = np.array(part["weights"].tolist(), float).reshape(len(part), window, -1)
                bias, out = part["intercept"].to_numpy(float), np.empty((len(part), horizon))
                for step in range(horizon):
                    oldest = step % window
                    out[:, step] = bias + np.einsum("nwc,nwc->n", ring, np.roll(weights, oldest, axis=1))
                    new = ring[:, oldest - 1].copy()
                    new[:, list(PLACES[metric])] = out[:, [step]]
                    ring[:, oldest] = new
                yield part[keys].assign(path=out.tolist())

    return state.select(*keys, "sequence", "intercept", "weights").mapInPandas(run, "location_id string, device_id string, metric_type string, path array<double>")


def sequence_forecast(history: DataFrame, maps: DataFrame, horizon: int, as_of: Column, window: int = WINDOW,
                      name: str = "Sequence Map", model_type: str = "deep_learning") -> DataFrame:
    """Every series, metric and step from the maps (metric_type, intercept, weights; oldest row first).

    A series with fewer complete rows than the window, or a metric without a map, takes the
    fallback's rows and status.
    """
    keys = [*SERIES, "metric_type"]
    hist = default_ids(history)
    newest = keep_first(complete(hist), SERIES, [F.col("hour_ts").desc()], window)
    row = F.struct("hour_ts", F.array(*[F.col(c).cast("double") for c in INPUTS]).alias("x"))
    state = newest.groupBy(*SERIES).agg(F.sort_array(F.collect_list(row)).alias("s")).where(F.size("s") == window)
    paths = rolled(_with_maps(state, maps), horizon, window).select(*keys, F.posexplode("path").alias("_i", "_p"))
    steps = paths.select(*keys, (F.col("_i") + 1).alias("horizon_step"), "_p")
    base = forecast.fallback_forecast(hist, SERIES, horizon).join(steps, [*keys, "horizon_step"], "left")
    start = F.unix_seconds(F.date_trunc("hour", as_of))
    return base.select(
        *keys, "horizon_step", F.timestamp_seconds(start + F.col("horizon_step") * 3600).alias("forecast_timestamp"),
        F.coalesce("_p", "base_forecast_value").alias("base_forecast_value"),
        F.when(F.col("_p").isNotNull(), model_status(F.lit(name), F.lit(model_type))).otherwise(F.col("model_status")).alias("model_status"),
    )


def _with_maps(state: DataFrame, maps: DataFrame) -> DataFrame:
    """Each series with the map of each metric it is forecast for."""
    metrics = F.explode(F.array(*[F.lit(m) for m in PLACES]))
    return state.select(*SERIES, F.transform("s", lambda v: v["x"]).alias("sequence"), metrics.alias("metric_type")).join(maps, "metric_type")
