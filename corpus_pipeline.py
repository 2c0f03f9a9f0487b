"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Its
result is written as Parquet below the shared folder and read again by the next stage, so a
lost executor costs at most one stage's tasks. All stages but the last return the columns of
`documents`, whatever these are; null texts, empty tables and repeated rows go by the rules
of the operators.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.llm import bpe, chosen_path, compression, exact_dedup, mixing
from hourlake.llm.common import folder, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (6): documents that fail the base or the compression bands go; lower limits are learned from `labels`."""
    return compression.keep_good(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (4): of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (9): of each class of near duplicates, the smallest doc_id stays."""
    return chosen_path.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (5): sources at target weights, nine tenths of the tokens, each document at most once."""
    return mixing.take(docs, F.expr("total * 9 div 10"), 1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (7): counts and digests of every document's token ids."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", good),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mixture),
    ("byte_bpe", encoded),
]

#: compression, the near-duplicate join and token ids are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
