"""Quality rules: a base of word counts, then compression bands.

A document's UTF-8 bytes are compressed with zstandard as a whole and in fixed chunks. The
compressed share (compressed bytes / bytes) must lie in the band of its length: text that
repeats itself falls below, random or encoded matter lies above. Short pieces compress worse
for want of context, so the bands are set per length. The upper limits lie a little above the
highest shares of the prose in the given tables; letters of several bytes, whose bytes are
less alike, get up to `ROOM` more. A text falls when too many of its chunks lie outside their
band, and sooner when they lie above it.

Above the fixed lower limits, which only catch plain repetition, lower limits are learned from
texts labelled as good (`fit`). Shares of good texts fall along a line over the logarithm of
their length, so each cell of half a doubling of length (and a quarter of bytes in letters of
several bytes, so that a script is only judged by its like) has its own line, and the limit
lies `WHOLE_BELOW` or `CHUNK_BELOW` standard deviations below it. A cell needs `ENOUGH` good
pieces; without them, or without labels, the fixed limits stand alone. All labelled rows that are
not held out take part, and only sums per cell leave the tasks.

Defined results: a null text has no words, zero counts and fails the base; an empty text
likewise. Repeated rows are judged alike. Texts of any length are read whole.
"""

from collections import Counter
from math import log2
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourlake.llm.common import back_to_rows, remainder, whole_rows


class Band(NamedTuple):
    """Limits of the compressed share, for pieces below so many bytes."""

    below: float
    least: float
    most: float


#: Bands of whole documents, and of chunks; a document falls when more than `BAD_CHUNKS` of its chunks
#: lie outside, or more than `NOISY_CHUNKS` above.
WHOLE = (
    Band(512, 0.35, 0.80), Band(768, 0.25, 0.75), Band(1024, 0.25, 0.68), Band(1536, 0.25, 0.63), Band(2048, 0.25, 0.585), Band(4096, 0.20, 0.57),
    Band(8192, 0.20, 0.525), Band(65_536, 0.15, 0.50), Band(float("inf"), 0.10, 0.50)
)
CHUNKS = (Band(512, 0.30, 0.80), Band(768, 0.20, 0.75), Band(1024, 0.20, 0.68), Band(float("inf"), 0.20, 0.64))
CHUNK, BAD_CHUNKS, NOISY_CHUNKS, LEVEL = 1024, 0.5, 0.25, 3
#: Added to the upper limits of a piece whose bytes all belong to letters of several bytes, in proportion.
ROOM, ASCII = 0.15, bytes(range(128))
#: Standard deviations that a piece may lie below the line of good pieces, and the pieces a line needs.
WHOLE_BELOW, CHUNK_BELOW, ENOUGH = 3.0, 2.5, 20
#: Cells of the learned limits: for whole texts (True) and chunks, by length and script, the line's start, slope and depth.
Limits = dict[tuple[bool, int, int], tuple[float, float, float]]
# Fixed values of the base: white space that parts words, and the symbols that are counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8").split()  # bytes split at exactly the six spaces
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = set(windows)
    if len(seen) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def several(data: bytes) -> float:
    """The share of bytes that belong to letters of several bytes."""
    return 0.0 if data.isascii() else len(data.translate(None, ASCII)) / len(data)


def cell(data: bytes) -> tuple[int, int]:
    """Half doublings of the length, and quarters of bytes in letters of several bytes."""
    return int(2 * log2(len(data))), int(4 * several(data))


def side(bands: tuple[Band, ...], data: bytes, share: float, limits: Limits) -> int:
    """-1 below the band of the bytes' length or the learned limit, 1 above, 0 within."""
    band = next(b for b in bands if len(data) < b.below)
    line = limits.get((bands is WHOLE, *cell(data)))
    least = band.least if line is None else max(band.least, line[0] + line[1] * log2(len(data)) - line[2])
    return (share > band.most + ROOM * several(data)) - (share < least)


def compressed_shares(data: bytes, tool: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[tuple[bytes, float]]]:
    """The share of the whole, and (bytes, share) of each chunk; a short last chunk joins the one before."""
    cuts = list(range(0, max(len(data) - chunk // 2, 1), chunk)) + [len(data)]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = len(tool.compress(data)) / len(data)
    if len(parts) == 1:
        return whole, [(data, whole)]
    return whole, [(p, len(tool.compress(p)) / len(p)) for p in parts]


def in_bands(data: bytes, tool: zstandard.ZstdCompressor, limits: Limits | None = None) -> tuple[bool, float, int, int]:
    """Whether a text passes, its share, its chunks and those outside their band."""
    if not data:
        return False, 0.0, 0, 0
    limits = limits or {}
    whole, chunks = compressed_shares(data, tool)
    sides = [side(CHUNKS, part, share, limits) for part, share in chunks]
    bad, noisy = len(sides) - sides.count(0), sides.count(1)
    passed = side(WHOLE, data, whole, limits) == 0 and bad <= BAD_CHUNKS * len(sides) and noisy <= NOISY_CHUNKS * len(sides)
    return passed, whole, len(sides), bad


FIELDS = {n: "long" for n in COUNTS} | {"base_failed": "boolean", "kept": "boolean", "share": "double", "n_chunks": "long", "bad_chunks": "long"}
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def fails_base(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]


def _pieces(batches):
    """doc_id and, of each text that passes the base, the cell, log length and share of the whole and of its chunks."""
    tool = zstandard.ZstdCompressor(level=LEVEL)
    kinds = pa.list_(pa.struct([("whole", pa.bool_()), ("size", pa.int32()), ("script", pa.int32()), ("x", pa.float64()), ("y", pa.float64())]))
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text, found = value.as_py() or "", []
            if not fails_base(base_counts(text)):
                data = text.encode("utf-8")
                whole, chunks = compressed_shares(data, tool)
                for is_whole, part, share in [(True, data, whole), *[(False, *c) for c in chunks]]:
                    size, script = cell(part)
                    found.append({"whole": is_whole, "size": size, "script": script, "x": log2(len(part)), "y": share})
            rows.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kinds)], ["doc_id", "pieces"])


def held_out(doc_id):
    """A quarter of the documents, from whose labels nothing is learned."""
    return remainder(doc_id, 4) == 2


def fit(docs: DataFrame, labels: DataFrame) -> Limits:
    """Lower limits from the labelled good rows that are not held out; {} without any.

    A doc_id with several labels is good if all of them say so; null ids and labels teach nothing.
    Texts stay where they are: they are measured first, and their few numbers meet the labels.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    schema = "doc_id long, pieces array<struct<whole: boolean, size: int, script: int, x: double, y: double>>"
    measured = rows.mapInArrow(_pieces, schema).where(F.size("pieces") > 0)
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("quality").cast("int"), F.lit(0))).alias("good")).where("good = 1")
    each = measured.join(good, "doc_id", "left_semi").select(F.inline("pieces"))
    lines = each.groupBy("whole", "size", "script").agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy")
    )
    limits: Limits = {}
    for r in lines.where(F.col("n") >= ENOUGH).collect():  # a row for each cell: at most 2 x 62 x 5
        slope = r.sxy / r.sxx if r.sxx > 1e-9 else 0.0
        spread = (max(r.syy - slope * r.sxy, 0.0) / r.n) ** 0.5
        depth = (WHOLE_BELOW if r.whole else CHUNK_BELOW) * spread
        limits[(r.whole, r.size, r.script)] = (round(r.y - slope * r.x, 9), round(slope, 9), round(depth, 9))
    return limits


def _judged(batches, carried: list[str], limits: Limits):
    tool = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            counts = base_counts(text)
            failed = fails_base(counts)
            passed, share, chunks, bad = in_bands(text.encode("utf-8"), tool, limits)
            rows.append((*counts, failed, passed and not failed, share, chunks, bad))
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        judged = [pa.array(c, ARROW[t]) for c, t in zip(columns, FIELDS.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + judged, carried + list(FIELDS))


def judge(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the compressed shares of every row."""
    fields = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _judged(batches, ["doc_id"], limits or {}), f"doc_id long, {fields}")


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of `docs` that pass base and bands, unchanged."""
    rows = whole_rows(docs, text=F.col("text").cast("string"))
    schema = T.StructType([rows.schema["row"]])
    for name, kind in FIELDS.items():
        schema = schema.add(name, kind)
    return back_to_rows(rows.mapInArrow(lambda batches: _judged(batches, ["row"], limits or {}), schema).where("kept"), docs.columns)
