"""Error metrics, time split, model ranking and choice."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.functions.models import default_ids
from hourlake.operators.ranking import keep_first, recent_n, spread_rank, with_rank
from hourlake.operators.tables import flag_matching

MIN_ROWS = 100
TIE = ["model_name", "model_type", "model_uri"]
MODES = ["global", "per_location"]


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list = ()) -> DataFrame:
    """n, mae, mse, rmse, rse, r2 and mape in one aggregation; pairs with NULL or NaN are left out."""
    y, p = F.col(label), F.col(prediction)
    ok = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    err = y - p
    a = (
        df.where(ok)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            F.avg(err * err).alias("mse"),
            F.var_pop(y).alias("_var"),
            (F.avg(F.when(F.abs(y) > 1e-9, F.abs(err / y))) * 100.0).alias("mape"),
        )
    )
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("mse") / F.col("_var")).when(F.col("n") > 0, F.lit(0.0))
    return a.select(
        *by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), F.sqrt("mse").alias("rse"), r2.alias("r2"), "mape"
    )


def cumulative_counts(df: DataFrame, ts: str) -> DataFrame:
    """(ts, n, before): rows per distinct time and rows before it.

    Running sums go over days, then inside each day, so no single task sees all times.
    """
    per = df.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("_day", F.to_date(ts))
    days = per.groupBy("_day").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return per.join(days, "_day").select(
        ts, "n", (F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")
    )


def clamp_ratio(r: float) -> float:
    return min(0.5, max(0.05, r))


def split_ts_exact(df: DataFrame, ts: str = "hour_ts", ratio: float = 0.2) -> DataFrame:
    """One row: the time at position max(1, floor(n * (1 - ratio))) of the global time order."""
    total = df.agg(F.count(ts).alias("n")).scalar()
    at = F.greatest(F.lit(1), F.floor(total * F.lit(1.0 - clamp_ratio(ratio))))
    c = cumulative_counts(df, ts).withColumn("_at", at)
    hit = (F.col("before") < F.col("_at")) & (F.col("_at") <= F.col("before") + F.col("n"))
    return c.where(hit).agg(F.min(ts).alias("split_ts"))


def mark_split(df: DataFrame, ts: str = "hour_ts", ratio: float = 0.2, exact: bool = True) -> DataFrame:
    """Add `is_test` (time >= split). The approximate split is one quantile pass with error 0.001."""
    if exact:
        split = split_ts_exact(df, ts, ratio)
    else:
        q = F.percentile_approx(F.unix_seconds(F.col(ts)), F.lit(1.0 - clamp_ratio(ratio)), F.lit(1000))
        split = df.agg(F.timestamp_seconds(q).alias("split_ts"))
    return df.withColumn("split_ts", split.scalar()).withColumn("is_test", F.col(ts) >= F.col("split_ts"))


def split_by_time(df: DataFrame, ts="hour_ts", ratio=0.2, exact=True, min_rows: int = MIN_ROWS):
    """(train, test); refuses too few rows and empty parts."""
    n = df.count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} rows, got {n}")
    marked = mark_split(df, ts, ratio, exact)
    train, test = (marked.where(F.col("is_test") == v).drop("is_test", "split_ts") for v in (False, True))
    if train.isEmpty() or test.isEmpty():
        raise ValueError("time split left one part empty")
    return train, test


def location_candidates(df: DataFrame, target: str, min_rows: int, top_n: int = 0) -> DataFrame:
    """Places with enough labelled rows, most first; 0 keeps all."""
    out = (
        df.where(F.col(target).isNotNull())
        .groupBy("location_id")
        .agg(F.min("province_id").alias("province_id"), F.count(F.lit(1)).alias("row_count"))
        .where(F.col("row_count") >= min_rows)
    )
    return out.orderBy(F.col("row_count").desc(), "location_id").limit(top_n) if top_n else out


def recent_rows(df: DataFrame, n: int) -> DataFrame:
    """Newest n rows per place."""
    return recent_n(df, ["location_id"], "hour_ts", n, ["device_id"])


def best_order() -> list[Column]:
    return [
        F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("r2").desc_nulls_last(),
        F.col("created_at").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in TIE],
    ]


def candidates(metrics: DataFrame, families: list[str]) -> DataFrame:
    return metrics.where(
        F.col("model_type").isin(families)
        & F.coalesce("training_mode", F.lit("global")).isin(MODES)
        & F.col("target_variable").isNotNull()
        & F.col("rmse").isNotNull() & F.col("mae").isNotNull() & F.col("r2").isNotNull()
    )


def select_best(metrics: DataFrame, families: list[str]) -> DataFrame:
    """Best row per (target, mode, place)."""
    keys = ["target_variable", F.coalesce("training_mode", F.lit("global")), F.coalesce("location_id", F.lit("global"))]
    return keep_first(candidates(metrics, families), keys, best_order())


def flag_best(metrics: DataFrame, families: list[str]) -> DataFrame:
    """Clear the flag on the families' rows, then set it on the best."""
    mine = F.col("model_type").isin(families) & F.coalesce("training_mode", F.lit("global")).isin(MODES)
    cleared = metrics.withColumn("is_best", F.when(mine, False).otherwise(F.col("is_best")))
    keys = {"target_variable": None, "model_name": None, "model_type": None, "training_mode": "global",
            "location_id": "global", "model_uri": ""}
    return flag_matching(cleared, select_best(metrics, families), keys, "is_best")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Rank per target; a missing flag becomes rank = 1. There are few targets, so ranks are spread."""
    r = spread_rank(metrics, ["target_variable"], best_order())
    return r.withColumn("is_best", F.coalesce("is_best", F.col("rank_order") == 1))


def leading_models(metrics: DataFrame, n: int) -> DataFrame:
    """Rows of the leaderboard that can be among the first n of a target, without ranking all.

    The first n of each target with one value of the flag hold them, and the row of rank 1, which
    a missing flag needs.
    """
    order = [*best_order(), F.col("location_id").asc_nulls_first()]
    few = with_rank(keep_first(metrics, ["target_variable", "is_best"], order, n), ["target_variable"], order)
    return few.withColumn("is_best", F.coalesce("is_best", F.col("rank_order") == 1)).drop("rank_order")


def sort_leaderboard(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(
        F.col("target_variable").asc(), F.col("is_best").desc(), F.col("rmse").asc_nulls_last(),
        F.col("mae").asc_nulls_last(), F.col("created_at").desc(), *[F.col(t).asc_nulls_last() for t in TIE],
        F.col("location_id").asc_nulls_first(),
    ).limit(n)


def top_models(df: DataFrame, n: int) -> DataFrame:
    return keep_first(
        df, ["target_variable"],
        [F.col("is_best").desc_nulls_last(), *best_order(), F.col("location_id").asc_nulls_first()], n,
    )


def leaderboard_for(entities: DataFrame, board: DataFrame, locations: DataFrame, n: int, direct: DataFrame | None = None) -> DataFrame:
    """Per entity at most n model rows, with their origin (0 direct, 1 local, 2 global).

    Evaluation rows of the entity itself (`direct`, with a sensor_id) win outright. Else the
    rows of its place or its province count, and global rows fill up what is left of n; an
    entity without local rows gets none. Rows equal in five keys are listed once. Rows are cut
    to the first n of each place, province and of all global ones before they meet entities.
    """
    e = entities.select("sensor_id", "location_id", "province_id").distinct()
    places = locations.select("location_id", "location_name", F.col("province_id").alias("_province"))
    b = board.join(places, "location_id", "left")
    order = [F.col("target_variable").asc(), F.col("is_best").desc_nulls_last(), F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(),
             F.col("created_at").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in TIE], F.col("location_id").asc_nulls_first()]
    cols, row = b.columns, F.struct(*b.columns)

    def first_rows(df: DataFrame, key: str) -> DataFrame:
        return keep_first(df.where(F.col(key).isNotNull()), [key], order, n).select(F.col(key).alias("_k"), row.alias("m"))

    near = e.join(first_rows(b, "location_id"), F.col("location_id") == F.col("_k")).select("sensor_id", "m").unionByName(
        e.join(first_rows(b, "_province"), F.col("province_id") == F.col("_k")).select("sensor_id", "m")).distinct().select("sensor_id", "m.*")
    own = None
    if direct is not None:
        own = direct.join(places, "location_id", "left").select("sensor_id", *cols)
        own = keep_first(own, ["sensor_id"], order, n).withColumns({"origin": F.lit(0)})
        near = near.join(own.select("sensor_id").distinct(), "sensor_id", "left_anti")
    local = keep_first(near, ["sensor_id"], order, n).withColumn("origin", F.lit(1))
    # n rows at most, carried as one array
    best = b.where(F.coalesce("training_mode", F.lit("global")) == "global").orderBy(*order).limit(n).agg(
        F.collect_list(row).alias("_g"))
    places_left = local.groupBy("sensor_id").agg((F.lit(n) - F.count(F.lit(1))).alias("_left")).where("_left > 0")
    fill = places_left.withColumn("_g", best.scalar()).select("sensor_id", F.explode(F.slice("_g", F.lit(1), F.col("_left").cast("int"))).alias("m"))
    parts = [local, fill.select("sensor_id", "m.*").withColumn("origin", F.lit(2)), *([own] if own is not None else [])]
    both = reduce(lambda x, y: x.unionByName(y), parts)
    keys = ["sensor_id", "target_variable", "model_name", "training_mode", "location_id", "created_at"]
    return keep_first(both, keys, [F.col("origin").asc(), *order]).drop("_province")


def choose_model(entities: DataFrame, metrics: DataFrame, strategy: str = "global_best_type",
                 families=("spark_mllib", "deep_learning"), targets=("temperature", "humidity")) -> DataFrame:
    """One model row per (entity, target), or NULLs when none exists.

    The best row of each scope is picked first (one per target, one per target
    and place), so the join to entities is one to one.
    """
    m = metrics.where(F.col("model_type").isin(list(families))).withColumn(
        "training_mode", F.coalesce("training_mode", F.lit("global"))
    )
    order = [F.coalesce("is_best", F.lit(False)).desc(), F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(),
             F.col("r2").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in TIE]]
    row = F.struct(*metrics.columns)
    g = keep_first(m.where("training_mode = 'global'"), ["target_variable"], order)
    l = keep_first(m.where("training_mode = 'per_location'"), ["target_variable", "location_id"], order)
    g = g.select(F.col("target_variable").alias("_t1"), row.alias("_g"))
    l = l.select(F.col("target_variable").alias("_t2"), F.col("location_id").alias("_loc"), row.alias("_l"))
    e = entities.withColumn("metric_type", F.explode(F.array(*[F.lit(t) for t in targets])))
    j = e.join(g, F.col("metric_type") == F.col("_t1"), "left")
    j = j.join(l, (F.col("metric_type") == F.col("_t2")) & (F.col("location_id") == F.col("_loc")), "left")
    pick = F.coalesce("_g", "_l") if strategy.startswith("global") else F.coalesce("_l", "_g")
    j = j.withColumn("_m", pick)
    return j.select(
        *entities.columns, "metric_type",
        *[F.col(f"_m.{c}").alias(c if c not in entities.columns else f"model_{c}") for c in metrics.columns if c != "target_variable"],
    )


def model_report(metrics: DataFrame) -> DataFrame:
    """Per target: rows by scope, distinct names and types, newest time, best model."""
    best = F.min_by("model_name", F.when(F.col("rmse").isNotNull(), F.struct("rmse", "model_name")))
    return metrics.groupBy("target_variable").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce("training_mode", F.lit("global")) == "global").alias("global_rows"),
        F.count_if(F.col("training_mode") == "per_location").alias("location_rows"),
        F.count_distinct("model_name").alias("model_names"),
        F.count_distinct("model_type").alias("model_types"),
        F.max("created_at").alias("latest_created_at"),
        best.alias("best_model"),
    )



def baseline_predictions(features: DataFrame) -> DataFrame:
    """Long (model_name, target_variable, label, prediction): naive models scored on every row."""
    from hourlake.operators.features import SERIES, series_window

    w = series_window()
    entries = []
    for target in ("temperature", "humidity"):
        for name, pred in (
            ("last_value", F.lag(target, 1).over(w)),
            ("seasonal_168", F.lag(target, 168).over(w)),
            ("rolling_24", F.avg(target).over(w.rowsBetween(-24, -1))),
        ):
            entries.append((name, target, pred))
    wide = features.select(
        *SERIES, "hour_ts", "temperature", "humidity", *[p.alias(f"_{n}_{t}") for n, t, p in entries]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model_name"), F.lit(t).alias("target_variable"), F.col(t).alias("label"),
                 F.col(f"_{n}_{t}").alias("prediction"))
        for n, t, _ in entries
    ]))
    return wide.select(*SERIES, "hour_ts", rows.alias("r")).select(*SERIES, "hour_ts", "r.*")


def baseline_metrics(features: DataFrame, created_at: Column) -> DataFrame:
    """Metrics table of the naive models: a global row and a row per place, from one scan of the predictions."""
    p = baseline_predictions(default_ids(features))
    long = p.withColumn("scope", F.explode(F.array(F.lit("global"), F.col("location_id"))))
    m = regression_metrics(long, "label", "prediction", ["model_name", "target_variable", "scope"])
    place = F.when(F.col("scope") != "global", F.col("scope"))
    return m.select(
        "model_name",
        F.lit("baseline").alias("model_type"),
        F.when(place.isNull(), "global").otherwise("per_location").alias("training_mode"),
        place.alias("location_id"),
        "target_variable", "mae", "rmse", "rse", "mape", "r2",
        F.col("n").alias("test_points"),
        F.concat_ws("/", F.lit("baseline:"), "model_name", "target_variable", "scope").alias("model_uri"),
        F.lit(None).cast("boolean").alias("is_best"),
        created_at.alias("created_at"),
    )
