"""Exact deduplication with a heavy-hitter split.

1. Every row gets the SHA-256 of its text, in the scan.
2. A Misra-Gries summary over the digests (`approx_top_k`: each task keeps a bounded table of
   counters, full tables are reduced by their median, tables are merged) names the digests
   that may be frequent. Its size is a parameter and does not grow with the data. Any digest
   with more than 3.5 / counters of all rows is among them.
3. For these candidates alone the exact count and the winner are computed, with partial
   aggregation. The verified winners, at most `heavy` rows of some 60 bytes, are broadcast,
   and rows with a frequent digest are settled or removed where they are read.
4. All other digests are shuffled in the ordinary way; none of their groups is large.

Defined results: null texts count as empty; among equal texts the row with the largest doc_id
stays, a null doc_id being smaller than any other; of repeated rows with the same doc_id the
one read last stays, so exactly one row of each group is kept. Columns of the caller keep
their names and values. Rows are told apart by their place in the scan, so the input should
be a table or another plan that reads alike each time.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import back_to_rows, whole_rows

#: Counters of a summary, and how many of the most frequent digests are taken as candidates.
COUNTERS, HEAVY = 16_384, 1_000


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _heavy(keyed: DataFrame, counters: int, heavy: int) -> DataFrame:
    """digest, group_size, winner (doc_id and place) of the frequent digests; at most `heavy` rows."""
    # the summary takes strings; two 60-digit halves would do no better than one
    hexed = keyed.select(F.hex("digest").alias("h"))
    top = hexed.agg(F.expr(f"approx_top_k(h, {heavy}, {counters})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias("digest"))
    return (
        keyed.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "place")).alias("winner"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest")
    )


def groups(docs: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """Every row's doc_id, keep_id, group_size, kept and text_sha256."""
    keyed = _keyed(docs)
    frequent = F.broadcast(_heavy(keyed, counters, heavy))
    marked = keyed.join(frequent, "digest", "left")
    here = F.struct("doc_id", "place")
    settled = marked.where("group_size IS NOT NULL").select("doc_id", "digest", "group_size", "winner", here.alias("here"))
    w = Window.partitionBy("digest")
    others = marked.where("group_size IS NULL").select(
        "doc_id", "digest", F.count("*").over(w).alias("group_size"), F.max(here).over(w).alias("winner"), here.alias("here")
    )
    return settled.unionByName(others).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("here") == F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """The rows of `docs` without all but one of each group of equal texts."""
    frequent = F.broadcast(_heavy(_keyed(docs), counters, heavy))
    rows = whole_rows(
        docs, place=F.monotonically_increasing_id(), doc_id=F.col("doc_id").cast("long"), digest=text_digest(F.col("text"))
    )
    marked = rows.join(frequent, "digest", "left").withColumn("here", F.struct("doc_id", "place"))
    settled = marked.where("here = winner")
    newest = Window.partitionBy("digest").orderBy(F.desc("here"))
    others = marked.where("winner IS NULL").withColumn("n", F.row_number().over(newest)).where("n = 1")
    return back_to_rows(settled.select("row").unionByName(others.select("row")), docs.columns)
