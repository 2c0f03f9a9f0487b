"""Near-duplicate classes and link counts: a chosen-path join on word shingles.

Texts are sets of hashed shingles of five words (a text with fewer words is one shingle).
Copies with the same words are first reduced to one representative, so groups of copies cost
nothing further. A representative is embedded as `HASHES` minwise values.

The join splits representatives recursively. At a node each set follows one or two of its
minwise values, which the node's random choice names (1 / similarity in the mean); sets that
share such a token meet at the child. A node with at most `SMALL` sets is compared by brute
force, larger ones are split on, `DEPTH` times at most. At that depth a node that is still
large is compared block against block, so it is no task's burden and no pair is left out.
Comparison by minwise values (with four standard deviations of leeway) gives candidate
components. `RUNS` repetitions follow from the target recall and the chance that a pair at
the threshold survives all levels.

An exact check follows: inside each candidate component every pair is compared by its full
shingle sets, block by block. This gives each text's exact number of links within its
component and the classes (components of true links). Only counts and one spanning edge a
text leave the tasks, never pairs.

Defined results: null texts count as empty; texts without words are in no class but their
own, copies of them included. Texts with equal words are one class. The class id is the
smallest doc_id of its rows (null ids count only where there is no other). n_links counts
different texts, not copies. Rows are told apart by their place in the scan, so the input
should be a table or another plan that reads alike each time.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlake.llm.common import back_to_rows, bounds, drop_folder, folder, sorted_groups, stored, whole_rows
from hourlake.llm.components import components

WORDS, SIMILARITY, HASHES, SMALL, DEPTH, BLOCK, RECALL, SEED = 5, 0.8, 64, 64, 3, 1024, 0.999, 11
MEMO = 500_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def random_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def survival(similarity: float, depth: int) -> float:
    """The chance that a pair of this similarity still meets after so many levels."""
    p, second = 1.0, 1 / similarity - 1
    for _ in range(depth):
        p = 1 - (1 - similarity * p) * (1 - second * similarity * p)
    return p


def runs_for(recall: float, similarity: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


class Shingles:
    """Sets of shingle hashes of texts; hashes of words are kept for a while."""

    def __init__(self, words: int = WORDS, seed: int = SEED):
        self.words, self.memo = words, {}
        self.factors = random_numbers(words, seed) | U(1)

    def of(self, parts: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, codes = self.memo, []
        for w in parts:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(h)
        h = np.array(codes, U)
        n = max(1, len(h) - self.words + 1)
        out = np.zeros(n, U)
        for k in range(min(self.words, len(h))):
            out += h[k : k + n] * self.factors[k]
        return np.unique(mix(out))


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minwise values, reduced to 16 bits."""
    out = np.empty(len(factors), U)
    for a in range(0, len(factors), 16):
        out[a : a + 16] = (hashes[None, :] * factors[a : a + 16, None] >> U(16)).min(axis=1)
    return (mix(out) & U(0xFFFF)).astype(np.uint16)


def needed(similarity: float, hashes: int) -> int:
    """Equal minwise values that a pair at the threshold has, but for four standard deviations."""
    return math.floor(hashes * similarity - 4 * math.sqrt(hashes * similarity * (1 - similarity)))


def profiles(docs: DataFrame, hashes: int = HASHES, seed: int = SEED) -> DataFrame:
    """place, doc_id, digest of the words (null without words), and minwise values of every row."""

    def run(batches):
        shingles, factors = Shingles(seed=seed), random_numbers(hashes, seed + 1) | U(1)
        for batch in batches:
            digests, signatures = [], []
            for text in batch.column("text"):
                parts = (text.as_py() or "").encode("utf-8").split()
                digests.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest() if parts else None)
                signatures.append(signature(shingles.of(parts), factors).tobytes() if parts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["place", "doc_id", "digest", "sig"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "place long, doc_id long, digest binary, sig binary")


def children(nodes: np.ndarray, signatures: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, child nodes): each row follows one or two of its minwise values, named by its node."""
    n, t = signatures.shape
    draw = mix(nodes[:, None] ^ random_numbers(t, 5)[None, :])
    first = draw.argmax(axis=1)
    rows = np.arange(n)
    more = np.flatnonzero((mix(nodes ^ U(0x51ED)) >> U(11)).astype(np.float64) / 2**53 < 1 / similarity - 1)
    draw[rows, first] = 0
    second = draw[more].argmax(axis=1) if len(more) else np.empty(0, np.int64)
    at, which = np.concatenate((rows, more)), np.concatenate((first, second))
    taken = (which.astype(U) << U(16)) | signatures[at, which].astype(U)
    return at, mix(mix(nodes[at] + U(0x9E3779B97F4A7C15)) ^ taken)


def _split(rows: DataFrame, runs: int | None, similarity: float) -> DataFrame:
    """rep and child node of rows (rep, sig) with `runs` roots, or of rows (rep, sig, node)."""

    def run(batches):
        roots = random_numbers(runs, 3) if runs else None
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column("rep").to_numpy()
            sig = matrix(batch.column("sig"))
            if roots is None:
                nodes = batch.column("node").to_numpy().view(U)
            else:
                nodes, reps, sig = np.tile(roots, len(reps)), np.repeat(reps, runs), np.repeat(sig, runs, axis=0)
            at, child = children(nodes, sig, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(child.view(np.int64))], ["rep", "node"])

    return rows.mapInArrow(run, "rep long, node long")


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long binary values as rows of 16-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def in_block_pairs(rows: DataFrame, group: str, size: str, key: str, block: int) -> DataFrame:
    """Rows with the pairs of blocks (i <= j) they belong to; groups up to one block have the pair 0, 0 alone."""
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(key), parts).cast("int")
    dealt = rows.withColumns({"parts": parts, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def spanning(n: int, alike, halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what `alike(i, js)` joins; pairs already connected are not compared again."""
    label, edges = np.arange(n), []
    for i in range(n - 1):
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(js):
            continue
        for j in js[alike(i, js)].tolist():
            if label[j] != label[i]:
                low, high = sorted((int(label[i]), int(label[j])))
                label[label == high] = low
                edges.append((i, j))
    return edges


def _candidate_edges(leaves: DataFrame, need: int) -> DataFrame:
    """Spanning edges (a, b) of the candidates in every bucket."""
    keys = ["node", "i", "j"]

    def run(batches):
        for part in sorted_groups(batches, keys):
            reps, sig = part.column("rep").to_numpy(), matrix(part.column("sig").combine_chunks())
            cut = bounds(part, keys)
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            hit = two[(sig[two] == sig[two + 1]).sum(axis=1) >= need]
            a, b = [reps[hit]], [reps[hit + 1]]
            for k in np.flatnonzero(size > 2):
                s, r = sig[cut[k] : cut[k + 1]], reps[cut[k] : cut[k + 1]]
                for x, y in spanning(len(s), lambda i, js, s=s: (s[js] == s[i]).sum(axis=1) >= need):
                    a.append(r[[x]])
                    b.append(r[[y]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = leaves.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "rep", "sig").mapInArrow(run, "a long, b long").distinct()


def candidates(reps: DataFrame, at: str, runs: int, similarity: float, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Spanning edges (a, b) between representatives (rep, sig) that are probably alike."""
    nodes, leaves = _split(reps.select("rep", "sig"), runs, similarity), None
    for level in range(1, depth + 1):
        nodes = stored(nodes, f"{at}/nodes{level}")
        met = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        live = stored(nodes.join(met, "node"), f"{at}/live{level}")
        done = live if level == depth else live.where(F.col("n") <= small)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = live.where(F.col("n") > small)
        if level == depth or large.isEmpty():
            break
        nodes = _split(large.join(reps.select("rep", "sig"), "rep"), None, similarity)
    dealt = in_block_pairs(leaves, "node", "n", "rep", block).join(reps.select("rep", "sig"), "rep")
    return _candidate_edges(dealt, needed(similarity, HASHES))


def _checked(members: DataFrame, similarity: float) -> DataFrame:
    """rep, links, label (smallest alike text in the block pair) and whether the component has more blocks."""
    keys = ["root", "i", "j"]

    def run(batches):
        shingles = Shingles()
        for part in sorted_groups(batches, keys):
            reps, own = part.column("rep").to_numpy(), part.column("own").to_numpy()
            i, j, parts = (part.column(k).to_numpy() for k in ("i", "j", "parts"))
            texts = part.column("text")
            cut, out = bounds(part, keys), []
            for a, b in zip(cut, cut[1:], strict=False):
                sets = [shingles.of((texts[k].as_py() or "").encode("utf-8").split()) for k in range(a, b)]
                links, label = count_links(sets, own[a:b] if i[a] != j[a] else None, similarity)
                order = reps[a:b]
                least = {r: order[label == r].min() for r in set(label.tolist())}
                out += [(int(order[k]), int(links[k]), int(least[label[k]]), bool(parts[a] > 1)) for k in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                ["rep", "links", "label", "more"],
            )

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "parts", "own", "rep", "text").mapInArrow(run, "rep long, links long, label long, more boolean")


def count_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of each set with the others (of the other side, where sides are given), and component labels."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flags = np.zeros(codes.max() + 1, np.int32)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i in range(n - 1):
        mine = codes[starts[i] : starts[i] + size[i]]
        flags[mine] = 1
        shared = np.add.reduceat(flags[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        flags[mine] = 0
        # in whole numbers: shared / union >= similarity
        hit = shared * 1_000_000 >= (size[i] + size[i + 1 :] - shared) * round(similarity * 1_000_000)
        if side is not None:
            hit &= side[i + 1 :] != side[i]
        js = np.flatnonzero(hit) + i + 1
        links[i] += len(js)
        links[js] += 1
        for j in js[label[js] != label[i]].tolist():
            if label[j] != label[i]:
                low, high = sorted((int(label[i]), int(label[j])))
                label[label == high] = low
    return links, label


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Every row's place, doc_id, class_id, class_size (rows), n_copies (rows with its words) and n_links."""
    spark = docs.sparkSession
    at = folder(spark, "chosen-path")
    every = stored(profiles(docs), f"{at}/profiles")
    grouped = every.where("digest IS NOT NULL").groupBy("digest")
    reps = stored(grouped.agg(F.min("place").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), f"{at}/reps")
    edges = candidates(reps, at, runs_for(recall, similarity, depth), similarity, small, depth, block)
    roots = components(edges, "chosen-path-candidates")  # written; what led to it is not read again
    for level in range(1, depth + 1):
        for step in ("nodes", "live"):
            drop_folder(spark, f"{at}/{step}{level}")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = stored(roots.join(sizes, "root").withColumnRenamed("node", "rep"), f"{at}/members")
    texts = docs.select(F.monotonically_increasing_id().alias("rep"), F.col("text").cast("string"))
    # members grow with the corpus, so texts meet them by a shuffle at every size
    dealt = texts.join(in_block_pairs(members, "root", "size", "rep", block).hint("merge"), "rep")
    checked = stored(_checked(dealt, similarity), f"{at}/checked")
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links"), F.min("label").alias("label"), F.max("more").alias("more"))
    if not checked.where("more").isEmpty():
        wide = components(checked.where("more AND rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")), "chosen-path-classes")
        links = links.join(wide.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "label", F.when(F.col("more"), F.coalesce("root", "rep")).otherwise(F.col("label"))
        )
    classes = stored(
        reps.select("digest", "rep", "n_copies").join(links.select("rep", "n_links", "label"), "rep", "left")
        .select("digest", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "rep").alias("label")),
        f"{at}/classes",
    )
    worded = every.select("place", "doc_id", "digest").join(classes, "digest", "left").select(
        "place", "doc_id", F.coalesce("label", "place").alias("label"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    worded = stored(worded, f"{at}/worded")
    heads = worded.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("head"))
    return worded.join(heads, "label").select(
        "place", "doc_id", "class_id", "class_size", "n_copies", "n_links", (F.col("head.place") == F.col("place")).alias("kept")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without all but one (that with the smallest doc_id) of each class."""
    dropped = stored(near_classes(docs, **how).where("NOT kept").select("place"), folder(docs.sparkSession, "chosen-path-dropped"))
    rows = whole_rows(docs, place=F.monotonically_increasing_id())
    return back_to_rows(rows.join(dropped, "place", "left_anti"), docs.columns)
