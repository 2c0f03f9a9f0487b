"""Substring deduplication on a compacted de Bruijn graph of word windows.

Windows of `WINDOW` consecutive words are the edges of a de Bruijn graph (nodes are the words
two neighbouring windows share). A window that also starts in a document with a smaller
doc_id is a repetition, and the words it covers go.

1. The minimizer of a window, the least hash among its runs of `PIECE` words, depends on the
   window's words alone. A document's windows with one minimizer form a stretch. Only
   minimizers that stand in two documents can hold repetitions; they are found from one row
   per document and minimizer, with partial aggregation.
2. The stretches of these minimizers are written, each with a hash of its words, those of its
   neighbours, and its windows' hashes. Texts meet their minimizers by a shuffle.
3. Equal stretches are one path of the graph. A path does not branch inside if its minimizer
   knows no other words; it is joined with the path after it in the first document that
   holds it, if each is the only neighbour of the other wherever they occur. Long repeated
   paths thus become one row, whose source is a place in that first document.
4. Where the head of a compacted path occurs, the path occurs whole. Its words are checked
   against those at the source coordinates (by a second, independent hash carried from
   there); then the whole span goes at once. Minimizers whose stretches differ (ends of
   passages, edited copies), or that fail the check, are compared window by window.
5. Spans are gathered per document, whose words are counted, removed and digested.

Hashes: a window is known by its minimizer and its own hash (128 bits), a path by its
minimizer, hash and check (192 bits).

Defined results: words are runs of characters other than space and the five controls from tab
to carriage return; null texts have none; documents with fewer words than a window keep
all; a row with a null doc_id keeps all its words and is no source; rows with equal doc_id
are no sources of each other; empty tables give an empty result. Other columns of the caller
are not read. Rows are told apart by their place in the scan, so the input should be a table
or another plan that reads alike each time.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import drop_folder, folder, stored

#: Words of a window and of a minimizer; bytes of text hashed at a time.
WINDOW, PIECE, CHUNK = 13, 6, 1 << 20
U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2 to the 64th, and their inverses, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.reach(1 << 12)

    def reach(self, n: int) -> None:
        if n <= self.n:
            return
        n = max(n, 2 * self.n)
        self.up, self.down = (np.cumprod(np.concatenate(([U(1)], np.full(n - 1, x, U)))) for x in (self.base, self.inverse))
        self.n = n

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomials of values[start:end], the same for equal values at any place."""
        self.reach(len(values) + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum(values * self.up[: len(values)])))
        return (total[ends] - total[starts]) * self.down[starts]


class Reader:
    """Word, window and stretch hashes of many texts at a time."""

    def __init__(self, window: int = WINDOW, piece: int = PIECE):
        self.window, self.piece = window, piece
        r = np.random.default_rng(13)
        odd = [int(x) | 5 for x in r.integers(1 << 60, 1 << 63, 5, dtype=np.int64)]
        self.bytes, self.second, self.runs, self.checks = (Powers(x) for x in odd[:4])
        self.letters, self.others = (r.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1) for _ in range(2))
        self.factors = scatter(np.arange(1, window + 1, dtype=U)) | U(1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, hash, second hash) of every word."""
        buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = SPACES[buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        ahead = np.cumsum([0] + [len(t) + 1 for t in texts])
        owner = np.searchsorted(ahead, starts, side="right") - 1
        size = (ends - starts).astype(U)
        first = scatter(self.bytes.sums(self.letters[buffer], starts, ends) + size)
        return owner, first, scatter(self.second.sums(self.others[buffer], starts, ends) + size)

    def stretches(self, texts: list[bytes]) -> dict[str, np.ndarray] | None:
        """Maximal runs of windows with one minimizer within a text; also `windows`, the hashes of all windows."""
        owner, h, other = self.words(texts)
        n = len(h) - self.window + 1
        if n <= 0:
            return None
        valid = owner[:n] == owner[self.window - 1 :]
        pieces = sum((h[k : len(h) - self.piece + 1 + k] * self.factors[k] for k in range(self.piece)), np.zeros(len(h) - self.piece + 1, U))
        pieces = scatter(pieces)
        least = pieces[:n].copy()
        for k in range(1, self.window - self.piece + 1):
            np.minimum(least, pieces[k : k + n], out=least)
        windows = sum((h[k : k + n] * self.factors[k] for k in range(self.window)), np.zeros(n, U))
        same = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
        begin = np.flatnonzero(valid & ~np.concatenate(([False], same)))
        end = np.flatnonzero(valid & ~np.concatenate((same, [False]))) + 1
        first_word = np.searchsorted(owner, owner[begin])
        return {
            "text": owner[begin], "begin": begin, "position": begin - first_word, "length": end - begin, "minimizer": least[begin].view(np.int64),
            "hash": scatter(self.runs.sums(scatter(h), begin, end + self.window - 1)).view(np.int64),
            "check": scatter(self.checks.sums(other, begin, end + self.window - 1)).view(np.int64), "windows": scatter(windows).view(np.int64),
        }


def chunks(batch: pa.RecordBatch):
    """Parts of a batch with about CHUNK bytes of text, or one text."""
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy()
    part = np.cumsum(size) // CHUNK
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _minimizers(keyed: DataFrame, window: int, piece: int) -> DataFrame:
    """minimizer and place, once per document."""

    def run(batches):
        reader = Reader(window, piece)
        for batch in batches:
            for part in chunks(batch):
                s = reader.stretches(_texts(part))
                if s is None:
                    continue
                order = np.lexsort((s["minimizer"], s["text"]))
                m, t = s["minimizer"][order], s["text"][order]
                new = np.concatenate(([True], (m[1:] != m[:-1]) | (t[1:] != t[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(m[new]), pa.array(part.column("place").to_numpy()[t[new]])], ["minimizer", "place"])

    return keyed.where("doc_id IS NOT NULL").select("place", "text").mapInArrow(run, "minimizer long, place long")


STRETCH = "place long, doc_id long, position int, length int, minimizer long, hash long, check long, before long, after long, windows array<long>"


def _stretches(rows: DataFrame, window: int, piece: int) -> DataFrame:
    """The stretches of repeated minimizers; before and after are 0 where no repeated stretch adjoins."""

    def run(batches):
        reader = Reader(window, piece)
        for batch in batches:
            for part in chunks(batch):
                s = reader.stretches(_texts(part))
                if s is None:
                    continue
                repeated = np.unique(part.column("minimizers").flatten().to_numpy())
                kept = np.flatnonzero(np.isin(s["minimizer"], repeated))
                if not len(kept):
                    continue
                text, begin, position, length, minimizer, h, check = (s[k][kept] for k in ("text", "begin", "position", "length", "minimizer", "hash", "check"))
                touch = (text[1:] == text[:-1]) & (position[:-1] + length[:-1] == position[1:])
                before, after = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
                before[1:][touch] = h[:-1][touch]
                after[:-1][touch] = h[1:][touch]
                ends = np.concatenate(([0], np.cumsum(length)))
                inside = np.repeat(begin, length) + np.arange(ends[-1]) - np.repeat(ends[:-1], length)
                windows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s["windows"][inside]))
                place, doc = (part.column(k).to_numpy()[text] for k in ("place", "doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), pa.array(doc), *[pa.array(x.astype(np.int32)) for x in (position, length)], *[pa.array(x) for x in (minimizer, h, check, before, after)], windows],
                    ["place", "doc_id", "position", "length", "minimizer", "hash", "check", "before", "after", "windows"],
                )

    return rows.select("place", "doc_id", "text", "minimizers").mapInArrow(run, STRETCH)


def compacted(stretches: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(heads of compacted paths, paths (minimizer, hash) that must be compared window by window).

    heads: minimizer, hash, check, doc_id and the source (place, position) of the path's first
    stretch, and `span`, the windows of the whole path.
    """
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0)
    paths = stretches.groupBy("minimizer", "hash").agg(
        F.min(F.struct("doc_id", "place", "position")).alias("source"), F.max("doc_id").alias("last"), F.first("length").alias("length"),
        F.min("check").alias("check"), (F.min("check") == F.max("check")).alias("sound"), one("before").alias("before"), one("after").alias("after"),
    )
    paths = stored(paths, f"{at}/paths")
    many = paths.groupBy("minimizer").agg((F.count("*") > 1).alias("many"), F.min("sound").alias("sound")).where("many OR NOT sound").select("minimizer")
    mixed = stored(paths.select("minimizer", "hash").join(many, "minimizer"), f"{at}/mixed")
    plain = paths.join(mixed.select("minimizer").distinct(), "minimizer", "left_anti").where("last > source.doc_id").select(
        "minimizer", "hash", "check", "length", "before", "after", "source.doc_id", "source.place", "source.position")
    # a path follows another one if they adjoin at the source and each is the other's only neighbour
    ends = plain.where("after <> 0").select("place", (F.col("position") + F.col("length")).alias("position"), F.col("hash").alias("before"), F.col("after").alias("hash"))
    follows = plain.where("before <> 0").join(ends, ["place", "position", "before", "hash"]).select("place", "position", F.lit(True).alias("follows"))
    linked = plain.join(follows, ["place", "position"], "left")
    along = Window.partitionBy("place").orderBy("position")  # the paths whose source is one document
    numbered = linked.withColumn("path", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(along))
    heads = numbered.groupBy("place", "path").agg(F.min_by(F.struct("minimizer", "hash", "check", "doc_id", "position"), "position").alias("head"), F.sum("length").cast("int").alias("span"))
    return stored(heads.select("head.*", "place", "span"), f"{at}/heads"), mixed


def spans(docs: DataFrame, at: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """place and spans (array of word positions from, to) of the repeated words of every document that has some."""
    keyed = _keyed(docs)
    every = stored(_minimizers(keyed, window, piece), f"{at}/minimizers")
    repeated = every.groupBy("minimizer").count().where("count > 1").select("minimizer")
    lists = stored(every.join(repeated, "minimizer").groupBy("place").agg(F.collect_list("minimizer").alias("minimizers")), f"{at}/lists")
    drop_folder(docs.sparkSession, f"{at}/minimizers")
    rows = keyed.where("doc_id IS NOT NULL").join(lists.hint("merge"), "place")
    stretches = stored(_stretches(rows, window, piece), f"{at}/stretches")
    heads, mixed = compacted(stretches.drop("windows"), at)
    # what becomes of a stretch: the span of the path it heads, or a look at each of its windows (span is null)
    fate = heads.select("minimizer", "hash", F.col("check").alias("source_check"), F.col("doc_id").alias("source_id"), "span").unionByName(mixed, allowMissingColumns=True)
    met = stretches.select("minimizer", "hash", "check", "doc_id", "place", "position", "windows").join(fate, ["minimizer", "hash"])
    met = met.where("span IS NULL OR (doc_id > source_id AND check = source_check)")
    met = stored(met.select("minimizer", "doc_id", "place", "position", "span", F.when(F.col("span").isNull(), F.col("windows")).alias("windows")), f"{at}/met")
    long = met.where("span IS NOT NULL").select("place", F.col("position").alias("a"), (F.col("position") + F.col("span") + (window - 1)).alias("b"))
    single = met.where("span IS NULL").select("minimizer", "doc_id", "place", "position", F.posexplode("windows").alias("i", "w"))
    single = single.select("minimizer", "w", "doc_id", "place", (F.col("position") + F.col("i")).alias("a"))
    first = stored(single.groupBy("minimizer", "w").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last")).where("last > source_id").drop("last"), f"{at}/first")
    short = single.join(first, ["minimizer", "w"]).where("doc_id > source_id").select("place", "a")
    # neighbouring windows become one span before they are gathered
    along = Window.partitionBy("place").orderBy("a")
    islands = short.withColumn("island", F.col("a") - F.row_number().over(along)).groupBy("place", "island").agg(F.min("a").alias("a"), (F.max("a") + window).alias("b")).drop("island")
    gathered = long.unionByName(islands).groupBy("place").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return stored(gathered, f"{at}/spans")


def _kept(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                words = (text or b"").split()
                n = len(words)
                if cut.is_valid:
                    covered = np.zeros(n + 1, np.int64)
                    np.add.at(covered, cut.values.field("a").to_numpy(), 1)
                    np.add.at(covered, cut.values.field("b").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(covered)[:n] == 0)]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            if out:
                n, removed, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by a space) of every document."""
    spark = docs.sparkSession
    at = folder(spark, "debruijn")
    cut = spans(docs, at, window, piece)
    for step in ("lists", "stretches", "paths", "mixed", "heads", "met", "first"):
        drop_folder(spark, f"{at}/{step}")
    return _kept(_keyed(docs).join(cut.hint("merge"), "place", "left").select("doc_id", "text", "spans"))


#: The contract in SQL, over `documents`.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
hashed AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS t FROM win),
marked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) < doc_id AS again FROM hashed),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM marked, range(13) r(k) WHERE again),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n, list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS k
  FROM w LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
