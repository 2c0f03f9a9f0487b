"""The queries of the numbered operators, with their SQL where SQL can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.llm import (
    bpe, chosen_path, compression, debruijn, exact_dedup, hard_negatives, language, line_templates, mixing, pii, ranked_search, toxicity, warc,
)
from hourlake.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents, short ones too, for every document."""
    return line_templates.decisions(table(spark, sf_dir, "documents"), least=1)


@query
def op4_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept row of every group of equal texts, for every document."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


ORACLES["op4_heavy_hitter_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: The mixture of op5: three quarters of all tokens, no source read more than three times.
MIX = (3, 4, 3)


@query
def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, with its leaf's tokens and budget."""
    num, den, epochs = MIX
    return mixing.mixed(table(spark, sf_dir, "documents"), F.expr(f"total * {num} div {den}"), epochs)


ORACLES["op5_hierarchical_mixing"] = mixing.sql(*MIX)


@query
def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands, for every document; limits learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    return compression.judge(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, for every document."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class, its size, copies and number of links, for every document."""
    return chosen_path.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_copies", "n_links", "kept")


@query
def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score, for every document; learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written, found through the capture index, and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


ORACLES["op3_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM g
"""


@query
def op2_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"))
    machine = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base digest and all spans of personal data, for every document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op11_clustered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; a seventh of the rows first change their label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op11_clustered_negatives"] = hard_negatives.SQL


@query
def op12_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_accumulator_search"] = ranked_search.SQL


@query
def op13_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeat 13-word windows of documents with smaller ids."""
    return debruijn.without_repeats(table(spark, sf_dir, "documents"))


ORACLES["op13_debruijn_substrings"] = debruijn.SQL
