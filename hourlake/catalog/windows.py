"""Windows, ranking, top-k, set operations."""

from pyspark.sql import functions as F

from hourlake.catalog.joins import steady
from hourlake.catalog.registry import query, r, rounded, shown
from hourlake.catalog.views import as_of, HORIZON, SQL_AS_OF
from hourlake.operators import evaluation, features, forecast, history, matching, ranking, tables
from hourlake.sources import weather

_S = "location_id, device_id, hour_ts"
_W = "PARTITION BY location_id, device_id ORDER BY hour_ts"


def _cols(df, *cols):
    return rounded(df.select("location_id", "device_id", "hour_ts", *cols))


def _sql_cols(*cols):
    return ", ".join(f"{r(c)} AS {c}" for c in cols)


LAGS = [f"{s}_lag_{k}" for s in ("temp", "humidity") for k in (1, 6, 12, 24)]
ROLL = [f"{s}_rolling_{n}" for s in ("temp", "humidity") for n in (24, 168)]
TARGETS = [f"{s}_target_{h}" for s in ("temp", "humidity") for h in (1, 168)]


@query("w1_add_lags", f"SELECT {_S}, {_sql_cols(*LAGS)} FROM features")
def w1(v):
    base = features.one_per_hour(features.prefer(v.joined))
    return _cols(features.add_lags(base, ["temperature", "humidity"]), *LAGS)


@query("w2_add_rolling", f"SELECT {_S}, {_sql_cols(*ROLL)} FROM features")
def w2(v):
    base = features.one_per_hour(features.prefer(v.joined))
    return _cols(features.add_rolling(base, ["temperature", "humidity"]), *ROLL)


@query("w3_rolling_min_max", f"""SELECT {_S}, {r(f"min(temperature) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")} AS temp_rolling_min_24,
  {r(f"max(temperature) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")} AS temp_rolling_max_24 FROM base_series""")
def w3(v):
    base = features.one_per_hour(features.prefer(v.joined))
    df = features.add_rolling(features.add_rolling(base, ["temperature"], (24,), "min"), ["temperature"], (24,), "max")
    return _cols(df, "temp_rolling_min_24", "temp_rolling_max_24")


@query("w4_add_targets", f"SELECT {_S}, {_sql_cols(*TARGETS)} FROM features")
def w4(v):
    base = features.one_per_hour(features.prefer(v.joined))
    return _cols(features.add_targets(base, ["temperature", "humidity"], (1, 168)), *TARGETS)


@query("gold_training_dataset", f"""SELECT {_S}, {_sql_cols('temperature', 'humidity', 'meteostat_temperature', 'meteostat_humidity')},
  CAST(hour AS INT) AS hour, CAST(day_of_week AS INT) AS day_of_week, CAST(month AS INT) AS month, {_sql_cols(*LAGS, *ROLL, *TARGETS)},
  {', '.join(f"{r(f'{fn}(2 * pi() * {c} / {p})')} AS {c}_{fn}" for c, p in (('hour', 24), ('month', 12), ('day_of_week', 7)) for fn in ('sin', 'cos'))}
  FROM features""")
def gold(v):
    f = features.build_features(v.joined, horizons=(1, 168), cyclic=True)
    return rounded(f.drop("province_id"))


@query("w1_time_spine", f"""
  WITH span AS (SELECT location_id, device_id, min(hour_ts) AS a, max(hour_ts) AS b FROM base_series GROUP BY 1, 2),
  hours AS (SELECT location_id, device_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour_ts FROM span),
  full_series AS (SELECT h.*, s.temperature FROM hours h LEFT JOIN base_series s ON s.location_id = h.location_id
    AND s.device_id IS NOT DISTINCT FROM h.device_id AND s.hour_ts = h.hour_ts)
  SELECT {_S}, {r('temperature')} AS temperature, {r(f"lag(temperature, 24) OVER ({_W})")} AS temp_lag_24 FROM full_series""")
def spine(v):
    f = features.build_features(v.joined, spine=True)
    return _cols(f, "temperature", "temp_lag_24")


@query("w5_dedupe_latest", """SELECT device_id, event_ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id, date_trunc('hour', event_ts)
  ORDER BY event_ts DESC, temperature DESC NULLS LAST, humidity DESC NULLS LAST, event_id DESC) AS rn FROM bronze_raw) WHERE rn = 1""")
def w5(v):
    keys = ["device_id", F.date_trunc("hour", "event_ts")]
    return ranking.dedupe(v.bronze_raw, keys, ranking.newest("event_ts", "temperature", "humidity", "event_id")).select(
        "device_id", "event_ts", "event_id")


_ORDER = "round(rmse, 9) NULLS LAST, round(mae, 9) NULLS LAST, round(r2, 9) DESC NULLS LAST, created_at DESC NULLS LAST, model_name, model_type, model_uri"
_BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_variable, coalesce(training_mode, 'global'),
    coalesce(location_id, 'global') ORDER BY {_ORDER}) AS rn FROM model_metrics WHERE model_type IN ('baseline') AND rmse IS NOT NULL
    AND mae IS NOT NULL AND r2 IS NOT NULL) WHERE rn = 1)"""
_M = "target_variable, training_mode, location_id, model_name"


@query("w6_select_best", f"WITH {_BEST} SELECT {_M}, {r('round(rmse, 9)')} AS rmse FROM best")
def w6(v):
    return rounded(evaluation.select_best(steady(v.model_metrics), ["baseline"]).select(*_M.split(", "), "rmse"))


@query("m7_flag_best", f"WITH {_BEST} SELECT {_M}, model_uri, model_uri IN (SELECT model_uri FROM best) AS is_best FROM model_metrics")
def m7(v):
    return evaluation.flag_best(steady(v.model_table), ["baseline"]).select(*_M.split(", "), "model_uri", "is_best")


_BOARD = f"board AS (SELECT *, row_number() OVER (PARTITION BY target_variable ORDER BY {_ORDER}) AS rank_order FROM model_metrics)"


@query("w7_leaderboard", f"WITH {_BOARD} SELECT {_M}, rank_order, coalesce(is_best, rank_order = 1) AS is_best, {r('round(mae, 9)')} AS mae FROM board")
def w7(v):
    return rounded(evaluation.leaderboard(steady(v.model_metrics)).select(*_M.split(", "), "rank_order", "is_best", "mae"))


@query("w8_recent_n", f"SELECT {_S} FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY hour_ts DESC, device_id DESC NULLS LAST) AS rn FROM base_series) WHERE rn <= 500")
def w8(v):
    base = features.one_per_hour(features.prefer(v.joined))
    return evaluation.recent_rows(base, 500).select("location_id", "device_id", "hour_ts")


@query("w8_recent_n_deep", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY event_ts DESC, id DESC) AS rn FROM metrics) WHERE rn <= 1500")
def w8d(v):
    return ranking.recent_n(v.metrics, ["metric_type"], "event_ts", 1500, ["id"]).select("id")


@query("w9_split_ts_exact", "SELECT event_ts AS split_ts FROM (SELECT event_ts, row_number() OVER (ORDER BY event_ts) AS rn, count(*) OVER () AS n FROM reference) WHERE rn = greatest(1, CAST(floor(n * 0.8) AS BIGINT))")
def w9(v):
    return evaluation.split_ts_exact(v.reference, "event_ts", 0.2)


@query("w10_latest_per_sensor", "SELECT sensor_id, id, event_ts FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_ts DESC, id DESC) AS rn FROM metrics) WHERE rn = 1")
def w10(v):
    return ranking.latest_per(v.metrics, ["sensor_id"], "event_ts", ["id"]).select("sensor_id", "id", "event_ts")


@query("w10_latest_per_metric", "SELECT metric_type, id, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY event_ts DESC, id DESC) AS rn FROM metrics) WHERE rn = 1")
def w10m(v):
    return ranking.latest_per(v.metrics, ["metric_type"], "event_ts", ["id"]).select("metric_type", "id", "metric_value")


@query("w10_latest_per_sensor_metric", "SELECT sensor_id, metric_type, id FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, metric_type ORDER BY event_ts DESC, id DESC) AS rn FROM metrics) WHERE rn = 1")
def w10s(v):
    return ranking.latest_per(v.metrics, ["sensor_id", "metric_type"], "event_ts", ["id"]).select("sensor_id", "metric_type", "id")


@query("w12_primary_device", """SELECT source, id, device_type FROM (SELECT 'nation_' || c_nationkey AS source, id, device_type,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN device_type = 'temperature_humidity' THEN 0 ELSE 1 END, id) AS rn FROM iot_devices) WHERE rn = 1""")
def w12(v):
    d = v.iot_devices.withColumn("source", F.concat(F.lit("nation_"), "c_nationkey"))
    return matching.primary_by_source(d).select("source", "id", "device_type")


def _choice(strategy):
    first, second = ("g", "l") if strategy.startswith("global") else ("l", "g")
    return f"""
  WITH {_BEST},
  pick AS (SELECT *, row_number() OVER (PARTITION BY target_variable, training_mode, coalesce(location_id, '') ORDER BY round(rmse, 9), round(mae, 9), round(r2, 9) DESC, model_name, model_type, model_uri) AS k FROM model_metrics)
  SELECT e.device_id, e.location_id, m.metric_type, coalesce({first}.model_name, {second}.model_name) AS model_name,
    coalesce({first}.training_mode, {second}.training_mode) AS training_mode
  FROM entities e CROSS JOIN (VALUES ('temperature'), ('humidity')) m(metric_type)
  LEFT JOIN pick g ON g.k = 1 AND g.training_mode = 'global' AND g.target_variable = m.metric_type
  LEFT JOIN pick l ON l.k = 1 AND l.training_mode = 'per_location' AND l.target_variable = m.metric_type AND l.location_id = e.location_id"""


@query("w13_choose_model_global", _choice("global_best_type"))
def w13(v):
    out = evaluation.choose_model(v.entities, steady(v.model_table), "global_best_type", ("baseline",))
    return out.select("device_id", "location_id", "metric_type", "model_name", "training_mode")


@query("w13_choose_model_location", _choice("per_location_first"))
def w13l(v):
    out = evaluation.choose_model(v.entities, steady(v.model_table), "per_location_first", ("baseline",))
    return out.select("device_id", "location_id", "metric_type", "model_name", "training_mode")


@query("w14_sequence_windows", f"""
  WITH numbered AS (SELECT *, row_number() OVER ({_W}) - 1 AS k FROM (SELECT * FROM series WHERE temperature IS NOT NULL AND humidity IS NOT NULL
      AND meteostat_temperature IS NOT NULL AND meteostat_humidity IS NOT NULL)),
  seq AS (SELECT location_id, device_id, hour_ts, k, temperature AS label, first_value(temperature) OVER w AS first_temperature,
    count(*) OVER w AS steps, sum(humidity) OVER w AS humidity_sum FROM numbered WINDOW w AS ({_W} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))
  SELECT {_S}, {r('label')} AS label, CAST(steps AS INT) AS steps, {r('first_temperature', 3)} AS first_temperature,
    {r('humidity_sum', 3)} AS humidity_sum FROM seq WHERE k >= 168 AND (k - 168) % 6 = 0""")
def w14(v):
    s = features.sequence_windows(v.series, "temperature", 168, stride=6)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[1].cast("double"))
    return s.select(
        "location_id", "device_id", "hour_ts", shown(F.col("label")).alias("label"), F.size("sequence").alias("steps"),
        shown(F.col("sequence")[0][0].cast("double"), 3).alias("first_temperature"), shown(total, 3).alias("humidity_sum"))


_CHART = f"""chart AS (
    SELECT coalesce(a.source, f.source) AS source, coalesce(a.ts, f.ts) AS ts, a.temperature, a.humidity, f.temperature AS forecast_temperature, f.humidity AS forecast_humidity
    FROM (SELECT sensor_id AS source, event_ts AS ts, temperature, humidity FROM readings) a
    FULL JOIN (SELECT source, forecast_ts AS ts, temperature, humidity FROM sensor_forecast) f ON a.source = f.source AND a.ts = f.ts)"""


@query("w15_bridge", f"""
  WITH {_CHART},
  fst AS (SELECT source, min(ts) AS first_ts FROM chart WHERE forecast_temperature IS NOT NULL OR forecast_humidity IS NOT NULL GROUP BY 1),
  lst AS (SELECT c.source, max(c.ts) AS last_ts FROM chart c JOIN fst ON fst.source = c.source AND c.ts < fst.first_ts
    WHERE temperature IS NOT NULL OR humidity IS NOT NULL GROUP BY 1)
  SELECT c.source, c.ts, {r('CASE WHEN c.ts = l.last_ts THEN coalesce(c.forecast_temperature, c.temperature) ELSE c.forecast_temperature END')} AS forecast_temperature,
    coalesce(c.ts = l.last_ts AND c.temperature IS NOT NULL AND c.forecast_temperature IS NULL, false) AS forecast_temperature_bridge
  FROM chart c LEFT JOIN lst l ON l.source = c.source""")
def w15(v):
    a = v.readings.select(F.col("sensor_id").alias("source"), F.col("event_ts").alias("ts"), "temperature", "humidity")
    f = v.wide_forecast.select("device_id", F.col("forecast_ts").alias("ts"), F.col("temperature").alias("forecast_temperature"),
                               F.col("humidity").alias("forecast_humidity"))
    out = features.bridge_beside(a, f, ["source"], "ts", v.source_gateway, "device_id")
    return rounded(out.select("source", "ts", "forecast_temperature", "forecast_temperature_bridge"))


@query("w17_forecast_snapshot", f"""SELECT device_id, forecast_ts, {r('temperature')} AS temperature FROM (SELECT *,
  row_number() OVER (PARTITION BY device_id ORDER BY CASE WHEN temperature IS NULL THEN 1 ELSE 0 END, forecast_ts) AS rn FROM wide_forecast) WHERE rn = 1""")
def w17(v):
    return rounded(forecast.forecast_snapshot(v.wide_forecast, ["device_id"]).select("device_id", "forecast_ts", "temperature"))


@query("t1_sort_leaderboard", f"""WITH {_BOARD} SELECT {_M}, {r('round(rmse, 9)')} AS rmse FROM board ORDER BY target_variable,
  coalesce(is_best, rank_order = 1) DESC, {_ORDER}, location_id NULLS FIRST LIMIT 20""")
def t1(v):
    return rounded(evaluation.sort_leaderboard(evaluation.leaderboard(steady(v.model_metrics)), 20).select(*_M.split(", "), "rmse"))


@query("t2_recent_alerts", f"""SELECT id, source, created_at FROM alert_table WHERE created_at >= {SQL_AS_OF} - INTERVAL 240 HOUR
  ORDER BY created_at DESC, id DESC LIMIT 100""")
def t2(v):
    return history.recent_alerts(v.alert_table, 240, 100, as_of()).select("id", "source", "created_at")


_STATUS = """sync_status AS (SELECT 'loc_' || o_custkey % 50 AS location_id, CAST(2022 + o_orderkey % 3 AS INT) AS year,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'partial' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + to_minutes(CAST(o_orderkey AS INT)) END AS finished_at FROM orders)"""


def sync_status(v):
    k = F.col("o_orderkey")
    return v.read("orders").select(
        F.concat(F.lit("loc_"), F.col("o_custkey") % 50).alias("location_id"), (2022 + k % 3).cast("int").alias("year"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("partial").alias("status"),
        F.when(k % 9 != 0, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k * 60)).alias("finished_at"))


_LATEST = f"""{_STATUS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, year ORDER BY finished_at DESC NULLS LAST, status) AS rn
  FROM sync_status) WHERE rn = 1)"""


@query("t3_latest_status", f"WITH {_LATEST} SELECT location_id, year, status, finished_at FROM latest")
def t3(v):
    return weather.latest_status(sync_status(v))


@query("t4_limit_locations", "SELECT location_id, latitude FROM dim_location ORDER BY location_id LIMIT 7")
def t4(v):
    return weather.limit_locations(v.dim_location, 7).select("location_id", "latitude")


@query("t5_top_models", f"""WITH {_BOARD} SELECT {_M} FROM (SELECT *, row_number() OVER (PARTITION BY target_variable
  ORDER BY coalesce(is_best, rank_order = 1) DESC, {_ORDER}, location_id NULLS FIRST) AS rn FROM board) WHERE rn <= 5""")
def t5(v):
    return evaluation.top_models(evaluation.leading_models(steady(v.model_metrics), 5), 5).select(*_M.split(", "))


@query("t6_forecast_head", f"""SELECT device_id, forecast_ts, {r('temperature')} AS temperature, {r('humidity')} AS humidity FROM (SELECT *,
  row_number() OVER (PARTITION BY device_id ORDER BY forecast_ts) AS rn FROM wide_forecast) WHERE rn <= 24""")
def t6(v):
    return rounded(forecast.forecast_head(v.wide_forecast, ["device_id"], 24).select("device_id", "forecast_ts", "temperature", "humidity"))


@query("t7_top_failing", f"""WITH {_STATUS} SELECT location_id, count(*) AS failures FROM sync_status WHERE status = 'failed' GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 10""")
def t7(v):
    from hourlake.operators.stations import top_failing

    return top_failing(sync_status(v).where("status = 'failed'"), ["location_id"], 10)


@query("u1_union_metrics", "SELECT metric_type, count(*) AS n FROM bias GROUP BY 1")
def u1(v):
    from hourlake.catalog.views import BIAS_DAYS

    b = forecast.recent_bias(v.joined, BIAS_DAYS, as_of())
    parts = [b.where(F.col("metric_type") == m) for m in ("temperature", "humidity")]
    return tables.union_rows(parts).groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))


@query("u3_dedupe", """SELECT location_id, event_ts, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY location_id, event_ts
  ORDER BY l_orderkey, l_linenumber, l_partkey, station_id, temperature_c, relative_humidity NULLS LAST) AS rn FROM reference_raw) WHERE rn = 1""")
def u3(v):
    from hourlake.catalog.views import REFERENCE_ORDER

    return ranking.dedupe(v.reference_raw, ["location_id", "event_ts"], ranking.oldest(*REFERENCE_ORDER)).select(
        "location_id", "event_ts", "l_orderkey", "l_linenumber", "l_partkey")


@query("u4_concat_dedupe", """SELECT source, id, part FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, id) AS rn FROM (
  SELECT source, id, 'generic' AS part, 0 AS o FROM generic_devices UNION ALL SELECT source, id, 'iot', 1 FROM iot_devices)) WHERE rn = 1""")
def u4(v):
    a = v.generic_devices.select("source", "id", F.lit("generic").alias("part"))
    b = v.iot_devices.select("source", "id", F.lit("iot").alias("part"))
    return tables.concat_dedupe([a, b], ["source"], [F.col("id").asc()])


@query("u5_merge_tail", "SELECT DISTINCT sensor_id, metric_value, event_ts FROM metrics")
def u5(v):
    late = F.col("event_ts") >= F.lit("2024-01-20").cast("timestamp")
    early = F.col("event_ts") < F.lit("2024-01-22").cast("timestamp")
    return tables.merge_tail(v.metrics.where(early), v.metrics.where(late), ["sensor_id", "metric_value", "event_ts"])


@query("m8_baseline_metrics", f"""SELECT model_name, training_mode, location_id, target_variable, {_sql_cols('mae', 'rmse', 'rse', 'mape', 'r2')},
  test_points, model_uri FROM model_metrics""")
def m8(v):
    return rounded(v.model_metrics.select(
        "model_name", "training_mode", "location_id", "target_variable", "mae", "rmse", "rse", "mape", "r2", "test_points", "model_uri"))


@query("m9_fallback_forecast", f"""SELECT location_id, device_id, metric_type, horizon_step, {r('base_forecast_value', 5)} AS base_forecast_value, model_status
  FROM own_fallback""")
def m9(v):
    return rounded(forecast.fallback_forecast(v.series, ["location_id", "device_id"], HORIZON), 5)
