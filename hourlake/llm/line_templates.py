"""Line dedup by a tree of log templates.

A line's words with a digit become the field `<*>`. Lines go down a tree of fixed depth: by
their number of words, then by their first `LEADING` words. In a leaf, a word weighs as much as
the lines that hold it in the same place. A template of a line is what stays when all its words
below some weight become fields; the leading words stay, `SIMILAR` of all words must, and no
word stays that is in fewer than `TEXTS` lines. Words of a field are in fewer lines than the
words around it, so one of these few templates is shared by all lines that differ in the field.
Templates found in `TEXTS` distinct texts or more are dropped everywhere; copies of a whole text
count as one text.

Where a leaf holds several templates, a field's words may weigh more than the constant words of
a rare template. Lines that have templates but none that recurs are therefore weighed again in
views: the lines of the leaf that agree in one segment of the words behind the leading ones. There
is one segment more than a template may have fields, and `VIEWS` at most.

Weights are sums and templates are counts, so the outcome depends neither on the order of the lines nor
on the size of a leaf, and no task holds a leaf. Words that are in more than a thousandth of all
rows, which are at most a thousand words, meet their weights by a broadcast, the others by a
shuffle. A line travels as hashes of 64 bits; only texts with a line in a leaf that could recur are read again.

Lines of fewer than `WORDS` words are compared as they are, with equal words in all places,
since a field would leave too little of them.

Defined results: null and empty texts have one line without words; a line without words is
never dropped, nor is one of fewer than `least` words (a parameter). Lines are parted by \\n;
repeated rows lose the same lines. An empty table loses nothing; other columns of the caller are not read.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlake.llm.common import back_to_rows, folder, stored, whole_rows

LEADING, WORDS, SIMILAR, TEXTS, VIEWS, MEMO = 3, 4, 0.75, 10, 8, 500_000
#: Words in more than this share of all rows are joined by a broadcast: no more than 1 / HOT of them exist.
HOT = 0.001
FIELD = "<*>"
DIGIT, VARIABLE = re.compile("[0-9]"), re.compile(r"\S*[0-9]\S*")


def words_of(line: str) -> list[str]:
    """A line's words, fields masked where there are enough words."""
    words = line.split()
    return VARIABLE.sub(FIELD, line).split() if len(words) >= WORDS and DIGIT.search(line) else words


def need_of(length: int, similar: float) -> int:
    """How many of so many words a template must keep."""
    return max(1, int(np.ceil(similar * length - 1e-9))) if length >= WORDS else length


def segment_of(length: int, similar: float, leading: int) -> np.ndarray:
    """The segment of each word behind the leading ones."""
    first = min(leading, length)
    parts = max(1, min(VIEWS, length - need_of(length, similar) + 1, length - first))
    return np.arange(length - first) * parts // max(1, length - first)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each bit of which depends on all bits given."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of words, kept for a while."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, out = self.memo, []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("place"), F.col("text").cast("string"))


def parsed(docs: DataFrame, leading: int = LEADING, least: int = WORDS) -> DataFrame:
    """place, line_no and hashes of text, leaf and line, for each line with enough words."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            rows: list[tuple] = []
            for place, value in zip(batch.column("place").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                sign = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                for no, line in enumerate(text.split("\n")):
                    words = words_of(line)
                    if len(words) < max(least, 1):
                        continue
                    h = hashes(words)
                    leaf = xxhash.xxh3_64_intdigest(h[:leading].tobytes() + len(words).to_bytes(4, "little"))
                    rows.append((place, no, sign, leaf - (1 << 63), xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["place", "line_no", "text", "leaf", "line"])

    return numbered(docs).mapInArrow(run, "place long, line_no int, text long, leaf long, line long")


def _words(docs: DataFrame, live: DataFrame, similar: float, leading: int) -> DataFrame:
    """A row for every word of the lines given by place and number: key (leaf, place in the line and word in one),
    n (words it stands for), need (words a template keeps), times and segment.

    The leading words are one row of no segment.
    """
    # the lines of one text, so no group is larger than a text
    chosen = live.groupBy("place").agg(F.collect_list(F.struct("line_no", "leaf", "line", "times")).alias("lines"))
    kinds = {"line": np.int64, "key": np.int64, "n": np.int32, "need": np.int32, "times": np.int64, "segment": np.int32}

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            for text, lines in zip(batch.column("text"), batch.column("lines"), strict=True):
                found, own = (text.as_py() or "").split("\n"), {k: [] for k in kinds}
                for x in lines.as_py():
                    h = hashes(words_of(found[x["line_no"]]))
                    first, leaf = min(leading, len(h)), np.array([x["leaf"]]).view(np.uint64)
                    at = np.arange(first, len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    own["key"].append(signed(mixed(np.concatenate((leaf, h[first:] + mixed(leaf + at))))))
                    own["segment"].append(np.append(-1, segment_of(len(h), similar, leading)))
                    size = len(h) - first + 1
                    own["n"].append(np.append(first, np.ones(size - 1, int)))
                    for k, v in (("line", x["line"]), ("need", need_of(len(h), similar)), ("times", x["times"])):
                        own[k].append(np.full(size, v))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own[k]).astype(t)) for k, t in kinds.items()], list(kinds))

    rows = numbered(docs).join(chosen, "place").select("text", "lines")
    return rows.mapInArrow(run, "line long, key long, n int, need int, times long, segment int")


def _templates(words: DataFrame, at: str, texts: int) -> DataFrame:
    """line and template, for every template of every line; `words` are stored rows of line, view, key, n, need, times."""
    totals = words.groupBy("key").agg(F.sum("times").alias("weight"), F.count("*").alias("rows")).where(F.col("weight") >= texts)
    totals = stored(totals, f"{at}/weights")
    hot = F.col("rows") > HOT * words.count()
    known = words.join(F.broadcast(totals.where(hot).select("key", F.col("weight").alias("hot"))), "key", "left")
    often = known.where("hot IS NOT NULL").withColumnRenamed("hot", "weight")
    rest = known.where("hot IS NULL").drop("hot").join(totals.where(~hot).select("key", "weight"), "key")
    # the words of one line, the heaviest first; words of equal weight stay or go together
    down = Window.partitionBy("line", "view").orderBy(F.desc("weight"))
    kept = often.unionByName(rest.select(often.columns)).select(
        "line", "view", "need", F.sum("n").over(down).alias("stay"), F.bit_xor("key").over(down).alias("sign")
    )
    return kept.where("stay >= need").select("line", F.xxhash64("view", "sign").alias("template")).distinct()


def _recurring(lines: DataFrame, templates: DataFrame, texts: int) -> DataFrame:
    """The lines with a template that is in so many distinct texts."""
    where = lines.select("line", "text").join(templates, "line").select("template", "text").distinct()
    often = where.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= texts)
    return templates.join(often, "template").select("line").distinct()


def recurring(lines: DataFrame, docs: DataFrame, at: str, texts: int = TEXTS, similar: float = SIMILAR, leading: int = LEADING) -> DataFrame:
    """The lines whose template is in so many distinct texts, from parsed lines and their texts."""
    first = F.min(F.struct("place", "line_no"))
    distinct = stored(lines.groupBy("leaf", "line").agg(F.count("*").alias("times"), first.alias("first")), f"{at}/lines")
    # leaves that cannot recur are left out; they are most
    leaves = distinct.groupBy("leaf").agg(F.sum("times").alias("all")).where(F.col("all") >= texts)
    live = distinct.join(leaves, "leaf").select("leaf", "line", "times", "first.place", "first.line_no")
    words = stored(_words(docs, live, similar, leading), f"{at}/words")
    wide = stored(_templates(words.withColumn("view", F.lit(0).cast("long")), f"{at}/leaf", texts), f"{at}/leaf/templates")
    found = stored(_recurring(lines, wide, texts), f"{at}/leaf/recurring")

    open_words = words.join(wide.select("line").distinct().join(found, "line", "left_anti"), "line", "left_semi")
    views = open_words.where("segment >= 0").groupBy("line", "segment").agg(F.bit_xor("key").alias("sign"), F.first("times").alias("times"))
    views = stored(views.select("line", "times", F.xxhash64("segment", "sign").alias("view")), f"{at}/views")
    alive = views.groupBy("view").agg(F.sum("times").alias("all")).where(F.col("all") >= texts).select("view")
    seen = open_words.join(views.join(alive, "view").select("line", "view"), "line")
    seen = stored(seen.select("line", "view", F.xxhash64("view", "key").alias("key"), "n", "need", "times"), f"{at}/seen")
    narrow = stored(_templates(seen, f"{at}/view", texts), f"{at}/view/templates")
    return stored(found.unionByName(_recurring(lines, narrow, texts)), f"{at}/recurring")


def dropped_lines(docs: DataFrame, least: int = WORDS, **how) -> DataFrame:
    """place and the numbers (from 0) of the lines to drop, for every row that has some."""
    at = folder(docs.sparkSession, "line-templates")
    lines = stored(parsed(docs, how.get("leading", LEADING), least), f"{at}/parsed")
    hits = lines.select("place", "line_no", "line").join(recurring(lines, docs, at, **how), "line")
    # the lines of one text, so no group is larger than a text
    return hits.groupBy("place").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))


def decisions(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and the dropped lines' numbers (comma-joined) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"))
    both = rows.join(dropped_lines(docs, **how), "place", "left")
    listed = F.coalesce(F.concat_ws(",", F.col("dropped").cast("array<string>")), F.lit(""))
    return both.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), listed.alias("dropped"))


def without_recurring(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` with recurring lines taken out of their texts."""
    rows = whole_rows(docs, place=F.monotonically_increasing_id()).join(dropped_lines(docs, **how), "place", "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("dropped"), i))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return back_to_rows(rows.withColumn("row", F.col("row").withField("text", text)), docs.columns)
