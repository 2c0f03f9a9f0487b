"""Model training and model forecasts. Fitted models have no SQL twin; their inputs and scores do."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hourlake.catalog.registry import query, r, rounded
from hourlake.catalog.views import BIAS_DAYS, HORIZON, SQL_AS_OF, as_of
from hourlake.functions.models import default_ids
from hourlake.operators import evaluation, features, tables
from hourlake.plans import forecasting, places, sequences, training

MIN_ROWS = 100


def frame(v):
    """The training table, stored once: fitting reads it many times."""
    return v.stored("training_features", training.training_frame(features.build_features(v.joined, horizons=(1, 168), cyclic=True)))


@query("m1_preprocess")
def m1(v):
    from pyspark.ml import Pipeline

    df = frame(v)  # with its gaps: medians fill them
    out = Pipeline(stages=training.preprocess_stages()).fit(df).transform(df)
    scaled = F.transform(vector_to_array("features"), lambda x: F.round(x, 6) + 0.0)
    return out.select("location_id", "device_id", "hour_ts", scaled.alias("inputs"))


@query("m2_model_specs")
def m2(v):
    metrics, _ = training.train_global(frame(v), as_of(), profile="full")
    return rounded(metrics.select("model_name", "target_variable", "mae", "rmse", "r2", "quality_label", "is_best"))


@query("m3_mark_split", """
  WITH s AS (SELECT hour_ts FROM (SELECT hour_ts, row_number() OVER (ORDER BY hour_ts) AS rn, count(*) OVER () AS n FROM series)
    WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT)))
  SELECT hour_ts >= (SELECT hour_ts FROM s) AS is_test, count(*) AS n FROM series GROUP BY 1""")
def m3(v):
    return evaluation.mark_split(v.series).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("m3_mark_split_approximate")
def m3a(v):
    return evaluation.mark_split(v.series, exact=False).groupBy("is_test", "split_ts").agg(F.count(F.lit(1)).alias("n"))


def global_metrics(v):
    """Metrics of the quick families on both targets, fitted once per input."""
    return v.stored("global_metrics", training.train_global(frame(v), as_of(), profile="quick")[0])


@query("m4_train_global")
def m4(v):
    return rounded(global_metrics(v).select("model_name", "target_variable", "training_mode", "mae", "rmse", "r2", "training_points", "test_points", "is_best"))


@query("m4_train_checks", """
  SELECT unnest(['temperature', 'humidity']) AS target_variable, 3 AS models, 1 AS best, true AS rmse_at_least_mae, true AS best_is_least, true AS all_points""")
def m4c(v):
    """What must hold of any run: one best model a target, the one with the least error; all usable rows train or test."""
    usable = frame(v).dropna(subset=training.NUMERIC).agg(*[F.count(c).alias(t) for t, c in training.TARGETS.items()])
    n = usable.select(F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in training.TARGETS]), F.array(*training.TARGETS))).alias("t", "n"))
    m = global_metrics(v).join(n, F.col("target_variable") == F.col("t"))
    least = F.min("rmse") == F.min(F.when(F.col("is_best"), F.col("rmse")))
    return m.groupBy("target_variable").agg(
        F.count("rmse").cast("int").alias("models"), F.count_if("is_best").cast("int").alias("best"), F.every(F.col("rmse") >= F.col("mae")).alias("rmse_at_least_mae"),
        least.alias("best_is_least"), F.every(F.col("training_points") + F.col("test_points") == F.col("n")).alias("all_points"))


@query("m5_final_refit")
def m5(v):
    """Every quick model of both targets, fitted again on all usable rows, over these rows."""
    df, out = frame(v), []
    _, models = training.train_global(df, as_of(), profile="quick", final_refit=True)
    for (target, name), model in models.items():
        p = model.transform(df.dropna(subset=[*training.NUMERIC, training.TARGETS[target]]))
        out.append(p.select("location_id", "device_id", "hour_ts", F.lit(target).alias("target_variable"), F.lit(name).alias("model_name"), "prediction"))
    return rounded(tables.union_rows(out))


def place_models(v):
    """(metrics, models) of the globally winning family at every place, fitted once per input."""
    made = places.train_winning_family(frame(v), global_metrics(v), as_of(), "p1", min_rows=MIN_ROWS)
    return v.stored("place_metrics", made[0]), v.stored("place_models", made[1])


_SCORES = ["location_id", "target_variable", "mae", "rmse", "r2", "test_points", "is_best"]


@query("m6_train_per_location")
def m6(v):
    metrics, _ = place_models(v)
    return rounded(metrics.drop("created_at"))


@query("m6_ridge_per_location")
def m6r(v):
    metrics, _ = training.train_per_location(frame(v), as_of(), min_rows=MIN_ROWS)
    return rounded(metrics.select(*_SCORES))


@query("m6_tree_per_location")
def m6t(v):
    """The same plan where a tree family has won: a tree of every place, then a forest."""
    out = []
    for name in ("Spark Decision Tree", "Spark Random Forest"):
        won = global_metrics(v).withColumn("is_best", F.col("model_name") == name)
        metrics, _ = places.train_winning_family(frame(v), won, as_of(), "p2", {"temperature": "temp_target_1"}, min_rows=MIN_ROWS)
        out.append(metrics.select("model_name", *_SCORES, "training_points"))
    return rounded(tables.union_rows(out))


_COUNTED = """(SELECT location_id, count(*) AS n FROM (SELECT coalesce(location_id, 'unknown') AS location_id, unnest(['temperature', 'humidity']) AS t, * EXCLUDE (location_id) FROM features)
    WHERE t = 'temperature' AND temp_target_1 IS NOT NULL AND temp_lag_24 IS NOT NULL AND meteostat_temperature IS NOT NULL AND meteostat_humidity IS NOT NULL GROUP BY 1)"""


@query("m6_place_points", f"""
  SELECT location_id, unnest(['humidity', 'temperature']) AS target_variable, greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS training_points,
    n - greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS test_points, 'location_refit_best_global_type' AS model_scope, true AS ordered FROM {_COUNTED} WHERE n >= 100""")
def m6p(v):
    """Which places take part, with how many rows on each side."""
    metrics, _ = place_models(v)
    return metrics.select("location_id", "target_variable", "training_points", "test_points", "model_scope", (F.col("rmse") >= F.col("mae")).alias("ordered"))


_XY = "(SELECT location_id, device_id, hour_ts, temperature, temp_target_1 AS y FROM features WHERE temp_target_1 IS NOT NULL)"


@query("m6_location_lines", f"""
  WITH c AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY hour_ts, coalesce(device_id, 'meteostat_only')) AS i,
      count(*) OVER (PARTITION BY location_id) AS n FROM {_XY})
  SELECT location_id, {r('regr_intercept(y, temperature)', 4)} AS intercept, {r('regr_slope(y, temperature)', 4)} AS slope FROM c
  WHERE n >= 100 AND i <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) GROUP BY 1""")
def m6l(v):
    """The same solver with one input and no penalty is the least-squares line of each place."""
    rows = training.location_split(frame(v), "temp_target_1", ["temperature"], MIN_ROWS)
    w = training.location_coefficients(rows.where("NOT is_test"), "temp_target_1", ["temperature"], l2=0.0)
    return rounded(w.select("location_id", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope")), 4)


def linear(v, df, target="temperature"):
    from pyspark.ml import Pipeline

    label = training.TARGETS[target]
    est = training.model_specs(label, "quick")["Spark Linear Regression"]
    return Pipeline(stages=[*training.preprocess_stages(), est]).fit(df.dropna(subset=[*training.NUMERIC, label]))


@query("m10_recursive_forecast")
def m10(v):
    """Lines over all inputs, both targets, the whole horizon."""
    df = frame(v)
    return rounded(tables.union_rows([training.recursive_forecast(linear(v, df, m), v.series, m, HORIZON, as_of()) for m in training.TARGETS]))


def forest(v, df, target, name="Spark Random Forest"):
    from pyspark.ml import Pipeline

    label = training.TARGETS[target]
    return Pipeline(stages=[*training.preprocess_stages(), training.model_specs(label, "quick")[name]]).fit(df.dropna(subset=[*training.NUMERIC, label]))


def _forests(v):
    df, name = frame(v), "Spark Random Forest"
    return tables.union_rows([training.recursive_forecast(forest(v, df, m, name), v.series, m, HORIZON, as_of(), name) for m in training.TARGETS])


@query("m10_forest_forecast")
def m10f(v):
    """Forests of 30 trees as node arrays, both targets, the whole horizon."""
    return rounded(_forests(v))


@query("m10_forecast_steps", f"""
  SELECT s.location_id, s.device_id, t.metric_type, CAST(unnest(range(1, {HORIZON + 1})) AS INT) AS horizon_step, {SQL_AS_OF} + to_hours(unnest(range(1, {HORIZON + 1}))) AS forecast_timestamp,
    CASE WHEN s.n >= 24 THEN 'trained_random_forest' ELSE 'insufficient_data' END AS model_status, true AS within
  FROM (SELECT location_id, device_id, count(*) AS n FROM series GROUP BY 1, 2) s, (SELECT unnest(['temperature', 'humidity']) AS metric_type) t""")
def m10s(v):
    """Every series, metric and step, its status, and that a mean of leaves stays within the values seen."""
    lo_hi = v.series.agg(*[f(c).alias(f"{n}_{c}") for c in training.TARGETS for n, f in (("lo", F.min), ("hi", F.max))])
    rows = _forests(v).crossJoin(F.broadcast(lo_hi))  # one row of limits
    low, high = (F.when(F.col("metric_type") == "temperature", F.col(f"{n}_temperature")).otherwise(F.col(f"{n}_humidity")) for n in ("lo", "hi"))
    within = F.col("base_forecast_value").between(low - 1e-6, high + 1e-6)
    return rows.select("location_id", "device_id", "metric_type", "horizon_step", "forecast_timestamp", "model_status", within.alias("within"))


_COMPLETE = f"""
  filled AS (SELECT location_id, device_id, hour_ts, temperature, humidity,
      {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY location_id, device_id ORDER BY hour_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY location_id, device_id ORDER BY hour_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c[10:13]}" for c in ("meteostat_temperature", "meteostat_humidity"))}
    FROM series),
  whole AS (SELECT * FROM filled WHERE tem IS NOT NULL AND hum IS NOT NULL),
  pairs AS (SELECT location_id, device_id, hour_ts, 'temperature' AS metric_type, temperature AS y, (temperature + tem) / 2 AS x FROM whole
    UNION ALL SELECT location_id, device_id, hour_ts, 'humidity', humidity, (humidity + hum) / 2 FROM whole),
  ago AS (SELECT *, lag(x, 24) OVER (PARTITION BY location_id, device_id, metric_type ORDER BY hour_ts) AS x24,
    row_number() OVER (PARTITION BY location_id, device_id, metric_type ORDER BY hour_ts DESC) AS back, count(*) OVER (PARTITION BY location_id, device_id, metric_type) AS n FROM pairs),
  line AS (SELECT metric_type, regr_intercept(y, x24) AS a, regr_slope(y, x24) AS b FROM ago GROUP BY 1),
  roll AS (SELECT location_id, device_id, g.metric_type, CAST(25 - back AS INT) AS step, a + b * x AS v FROM ago g JOIN line USING (metric_type) WHERE n >= 168 AND back <= 24
    UNION ALL SELECT location_id, device_id, r.metric_type, step + 24, a + b * v FROM roll r JOIN line USING (metric_type) WHERE step + 24 <= {HORIZON})"""


@query("m16_sequence_roll", f"""
  WITH RECURSIVE {_COMPLETE}
  SELECT f.location_id, f.device_id, f.metric_type, f.horizon_step, {SQL_AS_OF} + to_hours(f.horizon_step) AS forecast_timestamp,
    {r('coalesce(r.v, f.base_forecast_value)', 4)} AS base_forecast_value, CASE WHEN r.v IS NULL THEN f.model_status ELSE 'trained_deep_learning' END AS model_status
  FROM own_fallback f LEFT JOIN roll r ON r.location_id = f.location_id AND r.device_id = f.device_id AND r.metric_type = f.metric_type AND r.step = f.horizon_step""")
def m16(v):
    """A map of the last 168 rows, rolled forward: predictions enter the value and its reference."""
    history = v.stored("series", v.series)
    maps = v.stored("sequence_maps", sequences.seasonal_maps(history))
    return rounded(sequences.sequence_forecast(history, maps, HORIZON, as_of()), 4)


_FILLED = "(SELECT * REPLACE (coalesce(location_id, 'unknown') AS location_id, coalesce(device_id, 'meteostat_only') AS device_id) FROM features)"
_NEWEST = f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY location_id, device_id ORDER BY hour_ts DESC) AS rn FROM {_FILLED}) WHERE rn = 1)"


@query("m11_direct_forecast", " UNION ALL ".join(f"""SELECT '{m}' AS metric_type, location_id, device_id, hour_ts + to_hours(168) AS forecast_timestamp, 168 AS horizon_step,
  {r(f'a + b * {m}', 4)} AS prediction FROM {_NEWEST}, (SELECT regr_intercept({s}_target_168, {m}) AS a, regr_slope({s}_target_168, {m}) AS b FROM features)"""
    for m, s in features.SHORT.items()))
def m11(v):
    """The 168 h label's line, one for each metric, applied once to the newest row of every series."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, out = frame(v), []
    for metric, short in features.SHORT.items():
        label = f"{short}_target_168"
        stages = [VectorAssembler(inputCols=[metric], outputCol="features"), LinearRegression(labelCol=label, solver="normal")]
        model = Pipeline(stages=stages).fit(df.where(F.col(label).isNotNull()))
        out.append(training.direct_forecast(model, df, 168).withColumn("metric_type", F.lit(metric)))
    return rounded(tables.union_rows(out), 4)


@query("m11_direct_forecast_inputs")
def m11i(v):
    """The 168 h label by all inputs, both metrics: a line and a tree, applied once to the newest row of every series."""
    from pyspark.ml import Pipeline

    df, out = frame(v), []
    for metric, short in features.SHORT.items():
        label = f"{short}_target_168"
        usable = df.withColumn(label, F.col(label).cast("double")).dropna(subset=[*training.NUMERIC, label])
        for name in ("Spark Linear Regression", "Spark Decision Tree"):
            model = Pipeline(stages=[*training.preprocess_stages(), training.model_specs(label, "quick")[name]]).fit(usable)
            out.append(training.direct_forecast(model, df, 168).select("*", F.lit(metric).alias("metric_type"), F.lit(name).alias("model_name")))
    return rounded(tables.union_rows(out))


def _place_lines(label: str, value: str) -> str:
    return f"""SELECT f.location_id, f.device_id, f.hour_ts, {r(f'a + b * {value}', 4)} AS prediction FROM {_FILLED} f
  JOIN (SELECT location_id, regr_intercept({label}, {value}) AS a, regr_slope({label}, {value}) AS b FROM {_FILLED} WHERE {label} IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 100) c ON c.location_id = f.location_id"""


def _refit(v, label, inputs, df):
    w = training.refit_places(df, label, inputs)
    out = df.join(w, "location_id").withColumn("prediction", training.linear_prediction(inputs))
    return rounded(out.select("location_id", "device_id", "hour_ts", "prediction"), 4)


@query("m14_force_refit", _place_lines("humidity_target_1", "humidity"))
def m14(v):
    """One target's model refitted for every place, whatever is stored."""
    return _refit(v, "humidity_target_1", ["humidity"], frame(v))


@query("m15_refit_local", _place_lines("temp_target_1", "temperature"))
def m15(v):
    """Refit of every place with 100 rows or more; an input without any value counts as 0."""
    return _refit(v, "temp_target_1", ["temperature", "meteostat_humidity"], frame(v).withColumn("meteostat_humidity", F.lit(0.0)))


def _by_place(v, force: bool):
    """Both targets by all inputs: chosen place models are loaded where stored, else refitted by their family's name."""
    metrics, models = place_models(v)
    df, out = frame(v), []
    for target, label in training.TARGETS.items():
        chosen = metrics.where(F.col("target_variable") == target)
        w = places.load_or_refit_places(df, chosen, models, label, training.NUMERIC, force=force)
        rows = default_ids(df).fillna(0.0, training.NUMERIC).join(w, "location_id").where("origin <> 'insufficient_data'")
        out.append(rows.withColumn("prediction", places.prediction(training.NUMERIC)).select(
            "location_id", "device_id", "hour_ts", F.lit(target).alias("target_variable"), "origin", "prediction"))
    return rounded(tables.union_rows(out))


@query("m14_force_refit_inputs")
def m14i(v):
    return _by_place(v, True)


@query("m15_load_or_refit_inputs")
def m15i(v):
    return _by_place(v, False)


_ORIGIN = "CASE WHEN n >= 250 AND coalesce(TRY_CAST(regexp_extract(location_id, '([0-9]+)$', 1) AS INT) % 2 = 0, false) THEN 'loaded' WHEN n >= 250 THEN 'refitted' ELSE 'insufficient_data' END"


@query("m15_load_or_refit", f"""
  WITH rows_ AS (SELECT coalesce(location_id, 'unknown') AS location_id, coalesce(device_id, 'meteostat_only') AS device_id, hour_ts, temperature AS x, temp_target_1 AS y FROM features),
  labelled AS (SELECT *, count(*) OVER (PARTITION BY location_id) AS n, row_number() OVER (PARTITION BY location_id ORDER BY hour_ts, device_id) AS i FROM rows_ WHERE y IS NOT NULL),
  loaded AS (SELECT location_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM labelled WHERE n >= 250 AND i <= greatest(1, CAST(floor(n * 0.8) AS BIGINT)) GROUP BY 1),
  refitted AS (SELECT location_id, max(n) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM labelled GROUP BY 1),
  tagged AS (SELECT p.location_id, coalesce(n, 0) AS n, {_ORIGIN.replace("n >=", "coalesce(n, 0) >=")} AS origin, refitted.a, refitted.b FROM (SELECT DISTINCT location_id FROM rows_) p LEFT JOIN refitted USING (location_id))
  SELECT r.location_id, r.device_id, r.hour_ts, t.origin, {r("CASE t.origin WHEN 'loaded' THEN l.a + l.b * r.x WHEN 'refitted' THEN t.a + t.b * r.x END", 4)} AS prediction
  FROM rows_ r JOIN tagged t USING (location_id) LEFT JOIN loaded l USING (location_id)""")
def m15l(v):
    """Stored lines of every second place, refits of the others, and places with too few rows, in one result."""
    df, label, least = frame(v), "temp_target_1", 250
    rows = training.location_split(default_ids(df), label, ["temperature"], least)
    w = training.location_coefficients(rows.where("NOT is_test"), label, ["temperature"], 0.0)
    uri = F.concat(F.lit("runs:/l1/"), "location_id")
    chosen = w.select("location_id", F.lit("Spark Linear Regression").alias("model_name"), uri.alias("model_uri"))
    kept = w.where(F.regexp_extract("location_id", "([0-9]+)$", 1).try_cast("int") % 2 == 0)
    models = kept.select(uri.alias("model_uri"), "coefficients", F.lit(None).cast(places.NODES).alias("nodes"))
    got = places.load_or_refit_places(df, chosen, v.stored("place_lines", models), label, ["temperature"], least, l2=0.0)
    out = default_ids(df).join(got, "location_id").withColumn("prediction", places.prediction(["temperature"]))
    return rounded(out.select("location_id", "device_id", "hour_ts", "origin", "prediction"), 4)


@query("m17_sequence_stats", f"""
  WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY location_id, device_id ORDER BY hour_ts) - 1 AS k FROM series
      WHERE meteostat_temperature IS NOT NULL AND meteostat_humidity IS NOT NULL),
  labels AS (SELECT location_id, device_id, hour_ts, k FROM numbered WHERE k >= 168),
  split AS (SELECT hour_ts FROM (SELECT hour_ts, row_number() OVER (ORDER BY hour_ts) AS rn, count(*) OVER () AS n FROM labels)
    WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT))),
  steps AS (SELECT s.* FROM labels l JOIN numbered s ON s.location_id = l.location_id AND s.device_id = l.device_id AND s.k BETWEEN l.k - 168 AND l.k - 1
    WHERE l.hour_ts < (SELECT hour_ts FROM split))
  SELECT feature, {r('avg(x)')} AS mean, {r('greatest(var_pop(x), 1e-6)', 4)} AS variance FROM (
    SELECT 'temperature' AS feature, CAST(CAST(temperature AS FLOAT) AS DOUBLE) AS x FROM steps UNION ALL SELECT 'humidity', CAST(CAST(humidity AS FLOAT) AS DOUBLE) FROM steps
    UNION ALL SELECT 'meteostat_temperature', CAST(CAST(meteostat_temperature AS FLOAT) AS DOUBLE) FROM steps
    UNION ALL SELECT 'meteostat_humidity', CAST(CAST(meteostat_humidity AS FLOAT) AS DOUBLE) FROM steps) GROUP BY 1""")
def m17(v):
    from hourlake.catalog.registry import shown

    stats = training.sequence_stats(v.series, "temperature", 168)
    return stats.select("feature", shown(F.col("mean")).alias("mean"), shown(F.col("variance"), 4).alias("variance"))


_LINES = f"""
  xy AS (SELECT 'temperature' AS m, coalesce(location_id, 'unknown') AS location_id, coalesce(device_id, 'meteostat_only') AS device_id, hour_ts,
      temperature AS x, temp_target_1 AS y FROM features WHERE temp_target_1 IS NOT NULL AND temperature IS NOT NULL
    UNION ALL SELECT 'humidity', coalesce(location_id, 'unknown'), coalesce(device_id, 'meteostat_only'), hour_ts, humidity, humidity_target_1
    FROM features WHERE humidity_target_1 IS NOT NULL AND humidity IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY hour_ts) AS i, count(*) OVER (PARTITION BY m) AS n,
      row_number() OVER (PARTITION BY m, location_id ORDER BY hour_ts, device_id) AS li, count(*) OVER (PARTITION BY m, location_id) AS ln FROM xy),
  cut AS (SELECT m, hour_ts FROM ranked WHERE i = greatest(1, CAST(floor(n * 0.8) AS BIGINT))),
  coef AS (SELECT r.m, CAST(NULL AS VARCHAR) AS location_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM ranked r JOIN cut ON cut.m = r.m WHERE r.hour_ts < cut.hour_ts GROUP BY r.m
    UNION ALL SELECT m, location_id, regr_intercept(y, x), regr_slope(y, x) FROM ranked WHERE ln >= 100 AND li <= greatest(1, CAST(floor(ln * 0.8) AS BIGINT)) GROUP BY 1, 2)"""


def _model_forecast_sql() -> str:
    return f"""WITH RECURSIVE {_LINES},
  ways AS (SELECT unnest(['global_best_type', 'per_location_first']) AS strategy),
  picked AS (SELECT w.strategy, e.device_id, e.location_id, e.province_id, t.metric_type,
      CASE WHEN w.strategy = 'global_best_type' OR l.a IS NULL THEN g.a ELSE l.a END AS a, CASE WHEN w.strategy = 'global_best_type' OR l.a IS NULL THEN g.b ELSE l.b END AS b,
      CASE WHEN w.strategy = 'global_best_type' OR l.a IS NULL THEN 'global' ELSE e.location_id END AS scope
    FROM ways w, entities e, (SELECT unnest(['temperature', 'humidity']) AS metric_type) t
    LEFT JOIN coef g ON g.m = t.metric_type AND g.location_id IS NULL LEFT JOIN coef l ON l.m = t.metric_type AND l.location_id = e.location_id),
  begun AS (SELECT p.*, coalesce(o.total, q.total) AS total, coalesce(o.v, q.v) AS v FROM picked p
    LEFT JOIN own_tail o ON o.location_id = p.location_id AND o.device_id = p.device_id AND o.metric_type = p.metric_type AND o.back = 1
    LEFT JOIN place_tail q ON q.location_id = p.location_id AND q.metric_type = p.metric_type AND q.back = 1),
  roll AS (SELECT strategy, device_id, location_id, metric_type, a, b, scope, 1 AS step, a + b * v AS v FROM begun WHERE total >= 24 AND a IS NOT NULL
    UNION ALL SELECT strategy, device_id, location_id, metric_type, a, b, scope, step + 1, a + b * v FROM roll WHERE step < {HORIZON})
  SELECT w.strategy, f.device_id, f.location_id, f.metric_type, f.horizon_step, f.forecast_timestamp,
    {r('coalesce(m.v, f.base_forecast_value)', 4)} AS base_forecast_value, {r('coalesce(m.v, f.base_forecast_value) + f.bias_value', 4)} AS calibrated_forecast_value,
    CASE WHEN m.v IS NULL THEN 'fallback' ELSE '{forecasting.NAME}' END AS model_name, coalesce(m.scope, 'fallback') AS model_scope,
    CASE WHEN m.v IS NULL THEN f.model_status ELSE 'trained_{forecasting.TYPE}' END AS model_status,
    CASE WHEN m.v IS NOT NULL THEN 'runs:/r1/' || f.metric_type || '/' || m.scope END AS model_uri
  FROM ways w, forecast_rows f LEFT JOIN roll m ON m.strategy = w.strategy AND m.device_id = f.device_id AND m.location_id = f.location_id
    AND m.metric_type = f.metric_type AND m.step = f.horizon_step"""


@query("model_forecast", _model_forecast_sql())
def model_forecast(v):
    """Both strategies, with stored models that are loaded by their uri."""
    joined = v.stored("weather_joined", v.joined)
    history = v.stored("series", default_ids(features.one_per_hour(features.prefer(joined))))
    metrics, models = forecasting.linear_models(features.build_features(joined, horizons=(1,)), as_of(), "r1")
    metrics, models = v.stored("line_metrics", metrics), v.stored("line_models", models)
    out = [
        forecasting.model_forecast(history, v.entities, joined, metrics, models, HORIZON, as_of(), BIAS_DAYS, way).withColumn("strategy", F.lit(way))
        for way in ("global_best_type", "per_location_first")
    ]
    return rounded(tables.union_rows(out).select(
        "strategy", "device_id", "location_id", "metric_type", "horizon_step", "forecast_timestamp", "base_forecast_value",
        "calibrated_forecast_value", "model_name", "model_scope", "model_status", "model_uri"), 4)


@query("model_forecast_inputs")
def model_forecast_inputs(v):
    """Both strategies by all training inputs: lags, rolling means, calendar and reference."""
    joined = v.stored("weather_joined", v.joined)
    history = v.stored("series", v.series)
    inputs = {m: training.NUMERIC for m in training.TARGETS}
    metrics, models = forecasting.linear_models(frame(v), as_of(), "r2", inputs, l2=1e-3)
    metrics, models = v.stored("input_metrics", metrics), v.stored("input_models", models)
    out = [
        forecasting.model_forecast(history, v.entities, joined, metrics, models, HORIZON, as_of(), BIAS_DAYS, way, inputs).withColumn("strategy", F.lit(way))
        for way in ("global_best_type", "per_location_first")
    ]
    return rounded(tables.union_rows(out).select(
        "strategy", "device_id", "location_id", "metric_type", "horizon_step", "forecast_timestamp", "base_forecast_value",
        "calibrated_forecast_value", "model_name", "model_scope", "model_status", "model_uri"), 4)
