"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A token budget starts at the root and is divided at
each node among its children in proportion to their weights. A child's capacity is what its
leaves hold times the most epochs allowed; a child that cannot use its share is filled, and
what it leaves is divided anew among its siblings, by their weights. Since a node's budget is
cut only to the capacity of all it holds, shortages go to siblings first and reach the
siblings of an ancestor only where the whole branch is short.

Every leaf then reads its documents in epochs. Epoch e is ordered by md5(seed:e:doc_id). All
documents come once for each full epoch, and those of the longest prefix of the next epoch
whose tokens fit into the rest come once more.

Division is exact: the level to which unfilled siblings rise comes from running sums over the
siblings in the order of capacity by weight, in whole numbers; what rounding leaves goes to
the largest remainders. The windows hold one row for each child of a node. A leaf's prefix is
found from sums over hash buckets of some `bucket` documents; only the bucket in which the
rest runs out is ordered row by row, so a leaf with a third of all rows is spread like others.

Defined results: a null lang or source is the leaf "unknown"; null texts have no tokens, and
a leaf without any token gives no copies. A null doc_id counts as empty. Rows with equal
doc_id hold one place in an epoch's order: they are in a prefix together or not at all.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import back_to_rows, folder, stored, whole_rows

LEAF = ["domain", "lang", "source"]
UNKNOWN = "unknown"
#: The pattern of a token, the seed of the epochs, documents in a bucket.
WORD, SEED, BUCKET = r"[^\x20\x09-\x0D]+", 17, 5000


def default_domain(source: Column) -> Column:
    """A domain by the last character of the source's name."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6"), "books").otherwise("reference")


#: Whole-number weights; whatever is not named weighs 1.
DOMAINS, LANGUAGES = {"web": 5, "books": 3, "reference": 2}, {"en": 4, "de": 2}


def leaf_columns(domain=default_domain) -> list[Column]:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("lang", "source"))
    return [domain(source).alias("domain"), lang.alias("lang"), source.alias("source")]


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def divided(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `share` to rows with parent columns, child name, weight, cap and budget (the parent's)."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = children.withColumns({
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after),
    })
    full = ranked.withColumn("full", F.col("cap") * F.col("open") <= (F.col("budget") - F.col("filled")) * F.col("weight"))
    side = Window.partitionBy(*parent, "full")
    level = full.withColumns({
        # the first open sibling has the sums that hold for all open ones
        "rest": F.col("budget") - F.min("filled").over(side), "open": F.max("open").over(side),
    })
    part = F.col("rest") * F.col("weight")
    cut = level.withColumns({"floor": F.expr("(rest * weight) div open"), "left": part % F.col("open")})
    by_left = side.orderBy(F.desc("left"), child)
    extra = F.row_number().over(by_left) <= F.col("rest") - F.sum("floor").over(side)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("floor") + extra.cast("long"))
    return cut.withColumn("share", share).drop("filled", "open", "full", "rest", "floor", "left")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, domains=DOMAINS, languages=LANGUAGES, sources=None) -> DataFrame:
    """Leaves (domain, lang, source, tokens, docs) with `share`, the tokens that each is to give.

    `budget` is an expression over `total`, all tokens there are.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    tops = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    # one row per domain: the windows over () below hold as many rows as there are domains
    everything = Window.partitionBy(F.lit(0))
    total = F.floor(F.sum("cap").over(everything) / epochs).cast("long")
    tops = tops.withColumn("total", total).withColumn("budget", F.least(budget.cast("long"), F.sum("cap").over(everything)))
    tops = divided(tops.withColumns({"weight": _weight(F.col("domain"), domains), "root": F.lit(0)}), ["root"], "domain")
    langs = langs.join(tops.select("domain", F.col("share").alias("budget")), "domain")
    langs = divided(langs.withColumn("weight", _weight(F.col("lang"), languages)), ["domain"], "lang")
    caps = caps.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    caps = divided(caps.withColumn("weight", _weight(F.col("source"), sources or {})), ["domain", "lang"], "source")
    return caps.select(*LEAF, "tokens", "docs", "share")


def place(epoch: Column, doc_id: Column, seed: int) -> Column:
    """Where a document stands in an epoch, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _bucket(at: Column, docs: Column, bucket: int) -> Column:
    parts = F.greatest(F.lit(1), F.floor(docs / bucket)).cast("long")
    return F.shiftright(F.conv(F.substring(at, 1, 8), 16, 10).cast("long") * parts, 32)


def sized_rows(docs: DataFrame, domain=default_domain) -> DataFrame:
    """doc_id, the leaf and the tokens of every row: all that the decisions need."""
    tokens = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), *leaf_columns(domain), tokens.alias("n_tokens"))


def leaf_plan(sized: DataFrame, budget: Column, epochs: int, seed: int = SEED, bucket: int = BUCKET, **weights) -> DataFrame:
    """For every leaf: tokens, docs, share, full epochs, and the last place of the next epoch's prefix."""
    leaves = sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    shares = leaf_budgets(leaves, budget, epochs, **weights)
    some = F.col("tokens") > 0
    plan = shares.withColumn("full", F.when(some, F.expr("share div greatest(tokens, 1)")).otherwise(0)).withColumn(
        "rest", F.when(some, F.col("share") - F.col("full") * F.col("tokens")).otherwise(-1)
    )
    spark = sized.sparkSession
    plan = stored(plan, folder(spark, "mixing-shares"))
    rows = sized.join(plan.select(*LEAF, "full", "docs"), LEAF).withColumn("at", place(F.col("full"), F.col("doc_id"), seed))
    rows = rows.withColumn("bucket", _bucket(F.col("at"), F.col("docs"), bucket))
    # one key for a leaf's bucket: what follows is shuffled by it, and Spark may split a large leaf in the join above
    rows = rows.select(F.to_json(F.struct(*LEAF, "bucket")).alias("cell"), *LEAF, "n_tokens", "at", "bucket")
    named = [F.first(c).alias(c) for c in (*LEAF, "bucket")]
    sums = rows.groupBy("cell").agg(*named, F.sum("n_tokens").alias("held"), F.max("at").alias("last"))
    run = Window.partitionBy(*LEAF).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("held").over(run)).join(plan.select(*LEAF, "rest"), LEAF)
    whole = sums.where("upto <= rest").groupBy(*LEAF).agg(F.max("last").alias("until"))
    # the bucket in which the rest runs out: one for each leaf
    edge = sums.where("upto > rest AND upto - held <= rest").select("cell", *LEAF, (F.col("rest") - F.col("upto") + F.col("held")).alias("room"))
    within = Window.partitionBy("cell").orderBy("at")  # peers together
    part = rows.select("cell", "n_tokens", "at").join(edge.select("cell", "room"), "cell")
    part = part.withColumn("used", F.sum("n_tokens").over(within)).where("used <= room").groupBy("cell").agg(F.max("at").alias("inside"))
    part = part.join(edge, "cell").select(*LEAF, "inside")
    until = F.greatest(F.coalesce("inside", F.lit("")), F.coalesce("until", F.lit("")))
    return plan.join(whole, LEAF, "left").join(part, LEAF, "left").select(*plan.columns, until.alias("until"))


def _copies(seed: int) -> Column:
    prefix = place(F.col("full"), F.col("doc_id"), seed) <= F.col("until")
    return F.when(F.col("tokens") > 0, F.col("full") + prefix.cast("long")).otherwise(0).cast("long")


def mixed(docs: DataFrame, budget: Column, epochs: int, seed: int = SEED, **weights) -> DataFrame:
    """Every row's doc_id, leaf, n_tokens, the leaf's tokens and share, and how often it is taken."""
    spark = docs.sparkSession
    sized = stored(sized_rows(docs), folder(spark, "mixing-sizes"))
    plan = stored(leaf_plan(sized, budget, epochs, seed, **weights), folder(spark, "mixing-plan"))
    both = sized.join(plan, LEAF)
    return both.select("doc_id", *LEAF, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("share").alias("leaf_budget"), _copies(seed).alias("copies"))


def take(docs: DataFrame, budget: Column, epochs: int, seed: int = SEED, **weights) -> DataFrame:
    """The rows of `docs`, each as often as the mixture takes it."""
    spark = docs.sparkSession
    sized = stored(sized_rows(docs), folder(spark, "mixing-sizes"))
    plan = stored(leaf_plan(sized, budget, epochs, seed, **weights), folder(spark, "mixing-plan"))
    rows = whole_rows(docs, doc_id=F.col("doc_id").cast("long"), **dict(zip(LEAF, leaf_columns(), strict=True)))
    taken = rows.join(plan, LEAF).withColumn("copies", _copies(seed)).where("copies > 0")
    if epochs > 1:
        taken = taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return back_to_rows(taken, docs.columns)


#: The same in one statement, for a budget of {num}/{den} of all tokens and {epochs} epochs.
SQL = """
WITH sized AS (
  SELECT doc_id,
    CASE WHEN right(coalesce(source, 'unknown'), 1) IN ('0', '1', '2', '3') THEN 'web'
         WHEN right(coalesce(source, 'unknown'), 1) IN ('4', '5', '6') THEN 'books' ELSE 'reference' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS cap, 1 AS weight FROM sized GROUP BY ALL),
l2 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY ALL),
l1 AS (SELECT 0 AS root, domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS weight FROM l2 GROUP BY ALL),
p1 AS (SELECT *, CAST(least((sum(cap) OVER () // {epochs}) * {num} // {den}, sum(cap) OVER ()) AS BIGINT) AS budget FROM l1),
{one}
p2 AS (SELECT l2.*, s1.share AS budget FROM l2 JOIN s1 USING (domain)),
{two}
p3 AS (SELECT leaf.*, s2.share AS budget FROM leaf JOIN s2 USING (domain, lang)),
{three}
plan AS (SELECT domain, lang, source, tokens, share,
  CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS fully, CASE WHEN tokens > 0 THEN share % tokens ELSE -1 END AS rest FROM s3),
placed AS (SELECT sized.*, tokens, share, fully, rest, sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5(concat('17:', CAST(fully AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), '')))) AS used
  FROM sized JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, tokens AS leaf_tokens, CAST(share AS BIGINT) AS leaf_budget,
  CAST(CASE WHEN tokens > 0 THEN fully + CAST(used <= rest AS BIGINT) ELSE 0 END AS BIGINT) AS copies
FROM placed
"""
LEVEL_SQL = """
a{i} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM p{i} WINDOW w AS (PARTITION BY {parent} ORDER BY cap / weight, {child})),
b{i} AS (SELECT *, cap * opened <= (budget - filled) * weight AS fullup FROM a{i}),
c{i} AS (SELECT * EXCLUDE (filled, opened), budget - min(filled) OVER w AS rest, max(opened) OVER w AS opened FROM b{i} WINDOW w AS (PARTITION BY {parent}, fullup)),
d{i} AS (SELECT *, rest * weight // opened AS low, rest * weight % opened AS rem FROM c{i}),
e{i} AS (SELECT *, row_number() OVER (PARTITION BY {parent}, fullup ORDER BY rem DESC, {child}) <= rest - sum(low) OVER (PARTITION BY {parent}, fullup) AS extra FROM d{i}),
s{i} AS (SELECT * EXCLUDE (rest, opened, low, rem, extra, fullup, budget), CAST(CASE WHEN fullup THEN cap ELSE low + CAST(extra AS INT) END AS BIGINT) AS share FROM e{i}),
"""


def sql(num: int, den: int, epochs: int) -> str:
    levels = [("root", "domain"), ("domain", "lang"), ("domain, lang", "source")]
    one, two, three = (LEVEL_SQL.format(i=i, parent=p, child=c) for i, (p, c) in enumerate(levels, 1))
    return SQL.format(num=num, den=den, epochs=epochs, one=one, two=two, three=three)
