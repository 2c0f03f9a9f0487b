"""Models of single places, fitted for all places in one plan.

Lines come from sums of products per place. Trees are grown level by level: each level is one
aggregation of (count, sum, sum of squares) per place, node, input and bin, with partial
sums before the shuffle, so no task holds a place and nothing loops over places. A place's
model is one row: `coefficients`, or `nodes` with splits and leaf values.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.functions.models import default_ids, quality_label
from hourlake.operators import evaluation
from hourlake.operators.tables import union_rows
from hourlake.plans.training import (
    LOCATION_MIN_ROWS, NUMERIC, REFIT_MIN_ROWS, TARGETS, linear_prediction, location_coefficients, location_split,
)
from hourlake.session import cut_lineage

BINS, DEPTH, LEAST, TREES = 32, 8, 2, 10
#: Families grown as trees, by a part of the model's name; all others are lines.
KINDS = {"random forest": "forest", "decision tree": "tree", "gbt": "tree", "gradient": "tree"}
NODES = "array<struct<tree:int,node:bigint,feature:int,threshold:double,value:double,left:int,right:int>>"
MODEL = f"location_id string, coefficients array<double>, nodes {NODES}"


def kind_of(name: str | None) -> str:
    """`forest`, `tree` or `line`, by the name in a metrics row."""
    return next((kind for part, kind in KINDS.items() if part in (name or "").lower()), "line")


def family(name: Column) -> Column:
    """kind_of as a column."""
    n, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("line")
    for part, kind in reversed(KINDS.items()):
        out = F.when(n.contains(part), kind).otherwise(out)
    return out


def bin_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Inner limits of each input's bins, from one quantile pass over all places."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 1000).alias(str(i)) for i, c in enumerate(names)]).first()
    return [sorted(set(e or [])) for e in found]


def place_trees(train: DataFrame, label: str, names: list[str], edges: list[list[float]], trees: int = 1, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(location_id, nodes): a regression tree of every place, or a bagged forest.

    A row of a forest's tree counts as often as a hash draws it (Poisson, mean 1), and a node
    sees a hashed third of the inputs. Node n has the children 2n + 1 (input below the
    threshold) and 2n + 2; a leaf has no feature. `least` rows stay on each side of a split.
    """
    usable = [i for i, e in enumerate(edges) if e]
    # buckets are [limit, next limit): bucket <= b is value < limits[b]
    bucketed = Bucketizer(splitsArray=[[-float("inf"), *edges[i], float("inf")] for i in usable], inputCols=[f"_v{i}" for i in usable], outputCols=[f"_b{i}" for i in usable], handleInvalid="error")
    rows = train.select("location_id", F.col(label).cast("double").alias("y"), *[F.col(names[i]).cast("double").alias(f"_v{i}") for i in usable],
                        F.xxhash64(*[F.col(c) for c in train.columns]).alias("id"))
    rows = bucketed.transform(rows).select("location_id", "y", "id", F.array(*[F.col(f"_b{i}").cast("int") for i in usable]).alias("b"))
    if trees > 1:
        draw = F.pmod(F.xxhash64("id", "tree"), F.lit(1 << 20)) / float(1 << 20)
        # cumulated Poisson shares with mean 1
        weight = sum(((draw >= c).cast("double") for c in (0.36788, 0.73576, 0.9197, 0.98101, 0.99634)), F.lit(0.0))
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight).where("w > 0").drop("id")
    else:
        rows = rows.select("*", F.lit(0).alias("tree"), F.lit(1.0).alias("w")).drop("id")
    key = ["location_id", "tree", "node"]
    rows = cut_lineage(rows.select("location_id", "tree", F.lit(0).cast("long").alias("node"), F.lit(True).alias("open"), "y", "w", "b"))
    splits = None
    for _ in range(depth):
        cells = rows.where("open").select(*key, "y", "w", F.posexplode("b").alias("f", "bin")).groupBy(*key, "f", "bin").agg(
            F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
        if trees > 1:
            cells = cells.where(F.pmod(F.xxhash64("tree", "node", "f"), F.lit(3)) == 0)
        along = Window.partitionBy(*key, "f").orderBy("bin")
        whole = Window.partitionBy(*key, "f")
        cum = cells.select(*key, "f", "bin", F.sum("n").over(along).alias("n"), F.sum("s").over(along).alias("s"), F.sum("n").over(whole).alias("all_n"), F.sum("s").over(whole).alias("all_s"))
        gain = F.col("s") ** 2 / F.col("n") + (F.col("all_s") - F.col("s")) ** 2 / (F.col("all_n") - F.col("n")) - F.col("all_s") ** 2 / F.col("all_n")
        fit = cum.where(f"n >= {least} AND all_n - n >= {least}").withColumn("gain", F.round(gain, 9)).where("gain > 0")
        best = fit.groupBy(*key).agg(F.max_by(F.struct("f", "bin"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("cut"))
        best = best.select(*key, F.col("cut.f").alias("f"), F.col("cut.bin").alias("bin"))
        splits = best if splits is None else splits.unionByName(best)
        below = F.element_at("b", F.col("f") + 1) <= F.col("bin")
        # closed rows keep their node; a node without a good split closes
        child = F.when(F.col("f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(below, 1).otherwise(2))
        moved = rows.join(best, key, "left").select(*key[:2], child.alias("node"), (F.col("open") & F.col("f").isNotNull()).alias("open"), "y", "w", "b")
        rows = cut_lineage(moved)
    limit = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in edges[i]]) for i in usable]), F.col("f") + 1)
    inner = splits.select(*key, F.element_at(F.array(*[F.lit(i) for i in usable]), F.col("f") + 1).alias("feature"), F.element_at(limit, F.col("bin") + 1).alias("threshold"), F.lit(None).cast("double").alias("value"))
    leaves = rows.groupBy(*key).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value")).select(*key, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), "value")
    rows = inner.unionByName(leaves).groupBy("location_id").agg(F.sort_array(F.collect_list(F.struct("tree", "node", "feature", "threshold", "value"))).alias("nodes"))
    # children by their place in the list, so that a step down is one look-up
    number = lambda tree, node: tree.cast("long") * (1 << 40) + node
    rows = rows.withColumn("numbers", F.transform("nodes", lambda v: number(v["tree"], v["node"])))
    child = lambda v, side: F.when(v["feature"].isNotNull(), F.array_position("numbers", number(v["tree"], v["node"] * 2 + side))).cast("int")
    return rows.select("location_id", F.transform("nodes", lambda v: F.struct(
        v["tree"].alias("tree"), v["node"].alias("node"), v["feature"].alias("feature"), v["threshold"].alias("threshold"), v["value"].alias("value"),
        child(v, 1).alias("left"), child(v, 2).alias("right"))).alias("nodes"))


def tree_prediction(names: list[str], nodes: str = "nodes", depth: int = DEPTH) -> Column:
    """The mean over a place's trees, by built-in functions; NULL without trees."""
    x = F.array(*[F.col(c).cast("double") for c in names])
    roots = F.filter(F.transform(nodes, lambda v, i: F.when(v["node"] == 0, i + 1)), lambda i: i.isNotNull())

    def leaf(root: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            here = F.element_at(nodes, at)
            return F.when(here["feature"].isNull(), at).when(F.element_at(x, here["feature"] + 1) < here["threshold"], here["left"]).otherwise(here["right"])

        return F.element_at(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, down))["value"]

    return F.aggregate(F.transform(roots, leaf), F.lit(0.0), lambda a, v: a + v) / F.size(roots)


def prediction(names: list[str], depth: int = DEPTH) -> Column:
    """Of whichever model the row's place has."""
    return F.when(F.col("coefficients").isNotNull(), linear_prediction(names)).when(F.col("nodes").isNotNull(), tree_prediction(names, depth=depth))


def fitted(train: DataFrame, label: str, names: list[str], kind: str, l2: float = 1e-3, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(location_id, coefficients, nodes) of every place by one family."""
    spark = train.sparkSession
    if kind == "line":
        some = location_coefficients(train, label, names, l2)
    else:
        some = place_trees(train, label, names, bin_edges(train, names), trees if kind == "forest" else 1, depth)
    return union_rows([spark.createDataFrame([], MODEL), some.select("location_id", *[F.col(c) if c in some.columns else F.lit(None).cast(t).alias(c) for c, t in (("coefficients", "array<double>"), ("nodes", NODES))])])


def winners(metrics: DataFrame, targets) -> dict[str, str]:
    """The best global family's name by target: flagged rows first, then by the usual order. One row a target comes back."""
    m = metrics.where((F.col("training_mode") == "global") & (F.col("model_type") == "spark_mllib") & F.col("rmse").isNotNull())
    order = [F.coalesce("is_best", F.lit(False)).desc(), *evaluation.best_order()]
    best = evaluation.with_rank(m, ["target_variable"], order, "_rank").where("_rank = 1")
    return {r.target_variable: r.model_name for r in best.select("target_variable", "model_name").collect() if r.target_variable in targets}


def train_winning_family(df: DataFrame, metrics: DataFrame, created_at: Column, run: str, targets: dict[str, str] = TARGETS, names=NUMERIC, min_rows: int = LOCATION_MIN_ROWS,
                         max_rows: int | None = None, ratio: float = 0.2, final_refit: bool = False, horizon: int = 1, window: int = 168, trees: int = TREES, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(metrics, models) per place and target, of the family that won globally.

    Places need `min_rows` usable rows. Scores come from a place's last rows in time; with
    `final_refit` the stored model is fitted on all its rows again. A target without a global
    winner is left out.
    """
    names, rows, models = list(names), [], []
    kinds = winners(metrics, targets)
    for target, name in sorted(kinds.items()):
        label = targets[target]
        kind = kind_of(name)
        marked = cut_lineage(location_split(default_ids(df), label, names, min_rows, max_rows, ratio))
        train = marked.where("NOT is_test")
        model = cut_lineage(fitted(train, label, names, kind, trees=trees, depth=depth))
        scored = marked.where("is_test").join(model, "location_id").withColumn("prediction", prediction(names, depth))
        m = evaluation.regression_metrics(scored, label, "prediction", ["location_id"])
        counts = marked.groupBy("location_id").agg(F.min("province_id").alias("province_id"), F.count(F.lit(1) if final_refit else F.when(~F.col("is_test"), 1)).alias("training_points"))
        q = quality_label(F.col("r2"), F.col("rmse"))
        uri = F.concat_ws("/", F.lit(f"runs:/{run}"), F.lit(target), "location_id")
        rows.append(m.join(counts, "location_id").select(
            F.lit(name).alias("model_name"), F.lit("spark_mllib").alias("model_type"), F.lit("per_location").alias("training_mode"),
            F.lit("location_refit_best_global_type").alias("model_scope"), "location_id", "province_id", F.lit(1).alias("location_count"),
            F.lit(target).alias("target_variable"), F.lit(horizon).alias("horizon"), F.lit(horizon).alias("forecast_horizon_hours"), F.lit(window).alias("input_window_hours"),
            "mae", "rmse", "rse", "mape", "r2", "training_points", F.col("n").alias("test_points"), q["quality_label"].alias("quality_label"),
            q["confidence_score"].alias("confidence_score"), uri.alias("model_uri"), F.lit(run).alias("run_id"), F.lit(True).alias("is_best"), created_at.alias("created_at"),
        ))
        kept = cut_lineage(fitted(marked, label, names, kind, trees=trees, depth=depth)) if final_refit else model
        models.append(kept.select(uri.alias("model_uri"), "location_id", F.lit(target).alias("target_variable"), "coefficients", "nodes"))
    return union_rows(rows), union_rows(models)


def load_or_refit_places(df: DataFrame, chosen: DataFrame, models: DataFrame, label: str, names: list[str], min_rows: int = REFIT_MIN_ROWS,
                         force: bool = False, l2: float = 1e-3, depth: int = DEPTH) -> DataFrame:
    """(location_id, model_name, origin, coefficients, nodes) for every place of `df`, in one plan.

    `chosen` names a model (model_name, model_uri) per place, `models` holds what is stored
    (model_uri, coefficients, nodes). A place whose model is stored is `loaded`, unless
    `force`. The others are `refitted` on their own rows, by the family of the name (a line
    where there is no name), if at least `min_rows` carry the label; else `insufficient_data`.
    Missing inputs count as 0 in a refit.
    """
    rows = default_ids(df)
    places = rows.groupBy("location_id").agg(F.count(label).alias("_n"))
    c = chosen.select(F.col("location_id").alias("_l"), "model_name", "model_uri")
    have = models.select(F.col("model_uri").alias("_u"), *[F.col(x).alias(f"_{x}") for x in ("coefficients", "nodes")])
    tagged = places.join(c, F.col("location_id") == F.col("_l"), "left").join(have, F.col("model_uri") == F.col("_u"), "left")
    stored = F.lit(not force) & (F.col("_coefficients").isNotNull() | F.col("_nodes").isNotNull())
    origin = F.when(stored, "loaded").when(F.col("_n") >= min_rows, "refitted").otherwise("insufficient_data")
    tagged = cut_lineage(tagged.select("location_id", "model_name", origin.alias("origin"), "_coefficients", "_nodes", family(F.col("model_name")).alias("kind")))
    todo = tagged.where("origin = 'refitted'")
    # at most three families are named, whatever the number of places
    kinds = [r.kind for r in todo.select("kind").distinct().collect()]
    usable = rows.where(F.col(label).isNotNull()).fillna(0.0, names)
    refits = [fitted(usable.join(todo.where(F.col("kind") == k).select("location_id"), "location_id", "left_semi"), label, names, k, l2, depth=depth) for k in sorted(kinds)]
    new = union_rows(refits) if refits else df.sparkSession.createDataFrame([], MODEL)
    new = new.select(F.col("location_id").alias("_p"), "coefficients", "nodes")
    loaded = F.col("origin") == "loaded"
    return tagged.join(new, F.col("location_id") == F.col("_p"), "left").select(
        "location_id", "model_name", "origin",
        *[F.when(loaded, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in ("coefficients", "nodes")],
    )
