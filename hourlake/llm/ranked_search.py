"""Ranked lexical search: term at a time, with a limited set of accumulators.

Terms are runs of ASCII letters, ASCII digits and all characters beyond ASCII; only A-Z are
lowered. The queries are taken in slices whose texts have a bounded size. For each slice
the documents are read once: a row with a term of the slice is kept as its length and the
(term, occurrences) pairs, which is all the ranking reads from then on. Counts over all
documents (documents with a term, all terms, documents holding each term) follow by
aggregation.

The kept rows are ranked in blocks of `BLOCK` documents, each with its own small inverted
file. A query's terms are taken rarest first. Each posting adds to the accumulator of its
document, and makes one where there is none, as long as the best score the remaining terms
can still give (their largest contributions in the block, summed) is not below the k-th
partial score, or the k-th score of earlier blocks of the task. From then on no document
without an accumulator can be among the first k, and the remaining terms update survivors
only, exactly. A task sends its first k of each query; the rest is a rank over these few.

Defined results: null texts and texts without terms are never returned and count neither in
N nor in L; a null or empty query returns nothing; repeated query terms count repeatedly;
equal scores by ascending doc_id (null ids last); repeated rows of either table stand for
themselves, each ranked on its own; empty tables give an empty result. Other columns of the
callers are not read. No weight is negative, so partial scores only grow.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import drop_folder, folder, stored

#: Hits a query, documents a block, and bytes of query text a slice (bounds what is broadcast).
FIRST, BLOCK, SLICE = 20, 8192, 4 << 20

#: Bytes of terms stand for themselves (A-Z lowered), all others become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _slices(items: DataFrame, at: str, size: int):
    """Query rows (query, item_id, text) in lists of at most `size` bytes of text, or one text."""
    rows = stored(items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).withColumn("query", F.monotonically_increasing_id()), f"{at}/queries")
    before = Window.partitionBy("part").orderBy("query").rowsBetween(Window.unboundedPreceding, -1)
    # a part of the table at a time is numbered; part and piece together name a slice
    sized = rows.withColumns({"part": F.shiftright("query", 33), "size": F.coalesce(F.length("text"), F.lit(0))})
    cut = stored(sized.withColumn("piece", F.coalesce(F.floor(F.sum("size").over(before) / size), F.lit(0))), f"{at}/slices")
    for part, piece in sorted(map(tuple, cut.select("part", "piece").distinct().collect())):
        yield cut.where((F.col("part") == part) & (F.col("piece") == piece)).orderBy("query").select("query", "item_id", "text").collect()


def _postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), ids and times (of the terms asked for) of each row with a term."""
    asked = frozenset(number)

    def run(batches):
        for batch in batches:
            ids, count, sizes, at, times = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                seen = Counter(filter(asked.__contains__, words))
                ids.append(doc)
                count.append(len(words))
                sizes.append(len(seen))
                at += [number[t] for t in seen]
                times += seen.values()
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                ["doc_id", "n", "ids", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, times array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def accumulate(wanted: list[tuple[int, int]], starts: np.ndarray, rows: np.ndarray, gains: np.ndarray, most: np.ndarray, n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the accumulators of one query: its terms (id, repeats), rarest first, in one block.

    A term's postings are rows[starts[t]:starts[t+1]] with their gains, `most` the largest of
    each term; `floor` is a score that k documents are known to reach.
    """
    rest = sum(int(most[t]) * r for t, r in wanted)
    score, live, creating = np.zeros(n, np.int64), np.zeros(n, bool), True
    for t, repeats in wanted:
        if creating and rest < floor:
            creating = False
        a, b = starts[t], starts[t + 1]
        rest -= int(most[t]) * repeats
        at, gain = rows[a:b], gains[a:b] * repeats
        if creating:
            live[at] = True
            score[at] += gain
            held = score[live]
            if len(held) >= k and rest < held.max():
                floor = max(floor, int(np.partition(held, -k)[-k]))
        else:
            on = live[at]
            score[at[on]] += gain[on]
    found = np.flatnonzero(live & (score > 0))
    return found, score[found]


def first(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by ascending id, missing ids last."""
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], missing[near], -scores[near]))[:k]]
    return np.lexsort((ids, missing, -scores))[:k]


def _ranked(postings: DataFrame, wanted: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, block: int) -> DataFrame:
    """query, doc_id, score: the first k of each query from every task."""

    def run(batches):
        best = {q: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for q, _ in wanted}
        for batch in batches:
            for cut in range(0, batch.num_rows, block):
                part = batch.slice(cut, block)
                doc = part.column("doc_id")
                missing = doc.is_null().to_numpy(zero_copy_only=False)
                ids = doc.fill_null(0).to_numpy()
                lists = part.column("ids")
                sizes = lists.value_lengths().to_numpy()
                t, times = lists.flatten().to_numpy(), part.column("times").flatten().to_numpy()
                m = 75 + 25 * part.column("n").to_numpy() * n_docs // n_terms
                at = np.repeat(np.arange(part.num_rows), sizes)
                order = np.argsort(t, kind="stable")
                t, at, times = t[order], at[order], times[order]
                gains = weights[t] * (1_000_000_000 * times // (1000 * times + 12 * m[at]))
                starts = np.searchsorted(t, np.arange(len(weights) + 1))
                most = np.zeros(len(weights), np.int64)
                full = np.flatnonzero(np.diff(starts))
                if len(full):
                    most[full] = np.maximum(np.maximum.reduceat(gains, starts[full]), 0)
                for q, asked in wanted:
                    scores, held, gone = best[q]
                    floor = int(scores[-1]) if len(scores) == k else 0
                    found, new = accumulate(asked, starts, at, gains, most, part.num_rows, k, floor)
                    if len(found):
                        s, i, g = np.concatenate((scores, new)), np.concatenate((held, ids[found])), np.concatenate((gone, missing[found]))
                        keep = first(s, i, g, k)
                        best[q] = s[keep], i[keep], g[keep]
        for q, (scores, ids, gone) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q)), pa.array(ids, mask=gone), pa.array(scores)], ["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = FIRST, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every query (item_id, text)."""
    spark = docs.sparkSession
    at = folder(spark, "search")
    out = spark.createDataFrame([], "query long, item_id long, rank int, doc_id long, score long")
    for s, queries in enumerate(_slices(items, at, size)):
        asked = {q.query: Counter(terms(bytes(q.text) if q.text is not None else None)) for q in queries}
        number = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
        postings = stored(_postings(docs, number), f"{at}/postings{s}")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        # one row a term of the slice
        for r in postings.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        wanted = [(q, sorted(((number[t], r) for t, r in c.items() if df[number[t]]), key=lambda x: (df[x[0]], x[0]))) for q, c in asked.items()]
        wanted = [(q, w) for q, w in wanted if w]
        if not wanted:
            continue
        hits = _ranked(postings, wanted, weights, n_docs, n_terms, k, block)
        names = spark.createDataFrame([(q.query, q.item_id) for q in queries], "query long, item_id long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kept = stored(top.join(names, "query").select("query", "item_id", "rank", "doc_id", "score"), f"{at}/hits{s}")
        drop_folder(spark, f"{at}/postings{s}")
        out = out.unionByName(kept)
    return out.select("item_id", "rank", "doc_id", "score")


#: The same in SQL, over `documents` and `benchmark`.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
), tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
asked AS (
  SELECT item_id, t, count(*) AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY ALL
), part AS (
  SELECT item_id, doc_id, r * CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS s
  FROM asked JOIN df USING (t) JOIN tf USING (t) JOIN len USING (doc_id) CROSS JOIN total
), scored AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part GROUP BY ALL HAVING sum(s) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
