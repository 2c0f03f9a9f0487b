"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two strings counts the letter subsequences of length `ORDER` they share; every
letter a subsequence spans, gaps included, costs a factor `DECAY`. Inserted characters and
gaps thus lower the similarity of an insult only a little. Values are normalised by the
strings' own kernels.

Sentences are compared by their strings: words in lower case without anything but letters
(so `i.d-i_o.t` is one string), and runs of single letters joined (`i d i o t`). A sentence's
value is that of its most toxic string, its witness. Strings of more than `LONGEST` letters
are read through overlapping windows.

Training: the labels are those of documents, so the witnesses of toxic sentences are found
first: strings that are many times more frequent in toxic documents, counted over distinct
texts so that copies do not vote twice. Strings of clean sentences are the negatives; a second
round adds those that the first machine scores highest. Landmarks are drawn from both sides.
The machine is linear in the Nyström features. Since the kernel is a sum over subsequences,
its decision is folded into one weight for every subsequence of the landmarks, and scoring a
string needs its own subsequences only. A logistic curve over a text's three highest strings
makes the probability.

The fit reads at most `SAMPLE` labelled documents of each label (a parameter); scoring reads
every text whole. Defined results: null and empty texts have no strings and get the curve's
floor; if no label can be learned, every score is 0. Of several labels of a document the
largest counts; a null label teaches nothing. Repeated rows get the same score.
"""

from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlake.llm.common import folder, remainder, stored

ORDER, DECAY, LONGEST, SAMPLE = 3, 0.6, 24, 4000
LANDMARKS, POSITIVES, NEGATIVES, TOP, MEMO = 128, 400, 4000, 3, 700_000
SUPPORT, SUPPORT_SHARE, LIFT = 4, 0.004, 20


class Machine(NamedTuple):
    alphabet: str  # the landmarks' letters
    weights: np.ndarray  # of every subsequence of three letters, plus a zero for any other letter
    bias: float
    curve: np.ndarray  # of the three highest values, and the constant


def strings_of(word: str) -> list[str]:
    """A word's letters, through overlapping windows where there are many."""
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
    if len(letters) <= LONGEST:
        return [letters] if len(letters) >= ORDER else []
    return [letters[a : a + LONGEST] for a in range(0, len(letters) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str) -> set[str]:
    """Distinct words of a text, and its runs of single letters."""
    words = text.lower().split()
    found = set(words)
    if sum(len(w) == 1 for w in found) >= ORDER:
        run = ""
        for w in [*words, "  "]:
            if len(w) == 1 and w.isalpha():
                run += w
            elif run:
                if len(run) >= ORDER:
                    found.add(run)
                run = ""
    return found


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of three letters, and their decay."""
    i, j, k = (np.array(x) for x in zip(*combinations(range(n), ORDER), strict=True))
    return i, j, k, DECAY ** (k - i + 1.0)


@lru_cache(maxsize=64)
def lower(n: int) -> np.ndarray:
    """Decay of the letters between two places, the first being earlier."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0)


def codes(strings: list[str]) -> np.ndarray:
    """Equally long strings as rows of code points."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)


def kernels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernels of paired rows of code points."""
    same = (a[:, :, None] == b[:, None, :]) * DECAY**2
    left, right = lower(a.shape[1]), lower(b.shape[1]).T
    now = same
    for _ in range(ORDER - 1):
        now = same * (left @ now @ right)
    return now.sum(axis=(1, 2))


def by_length(strings: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        out.setdefault(len(s), []).append(i)
    return out


def own_kernels(strings: list[str]) -> np.ndarray:
    out = np.zeros(len(strings))
    for at in by_length(strings).values():
        for a in range(0, len(at), 2000):
            c = codes([strings[i] for i in at[a : a + 2000]])
            out[at[a : a + 2000]] = kernels(c, c)
    return out


def similarities(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of strings (rows) and landmarks (columns)."""
    out = np.zeros((len(strings), len(landmarks)))
    for at in by_length(strings).values():
        mine = codes([strings[i] for i in at])
        for j, z in enumerate(landmarks):
            out[at, j] = kernels(mine, np.broadcast_to(codes([z]), (len(at), len(z))))
    norm = np.sqrt(np.outer(own_kernels(strings), own_kernels(landmarks)))
    return out / np.maximum(norm, 1e-300)


def letter_ids(machine: Machine, rows: np.ndarray) -> np.ndarray:
    """Places in the alphabet; letters that no landmark has share the last one."""
    known = np.array([ord(c) for c in machine.alphabet], np.uint32)
    at = np.minimum(np.searchsorted(known, rows), len(known) - 1)
    return np.where(known[at] == rows, at, len(known))


def decide(machine: Machine, strings: list[str]) -> np.ndarray:
    """The machine's decision for every string."""
    out = np.full(len(strings), machine.bias)
    for n, at in by_length(strings).items():
        i, j, k, decay = triples(n)
        step = max(1, 400_000 // len(i))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            rows = codes([strings[x] for x in part])
            ids = letter_ids(machine, rows)
            inner = (machine.weights[ids[:, i], ids[:, j], ids[:, k]] * decay).sum(axis=1)
            out[part] += inner / np.sqrt(np.maximum(kernels(rows, rows), 1e-300))
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Primal Newton steps for a linear machine with squared hinge loss; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xa, ca = x[inside], c[inside]
        new = np.linalg.solve(eye + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def disguised(word: str) -> str:
    """The word with one letter inserted; letter and place follow from the word."""
    h = xxhash.xxh3_64_intdigest(word)
    at = 1 + h % (len(word) - 1)
    return word[:at] + chr(ord("a") + (h >> 32) % 26) + word[at:]


def train(positive: list[str], negative: list[str]) -> Machine:
    """Landmarks from both sides, Nyström features, the machine, and its folded weights."""
    positive, negative = ([s for s in x if ORDER <= len(s) <= LONGEST] for x in (positive, negative))
    half = LANDMARKS // 2
    landmarks = sorted({*positive[:half], *negative[: LANDMARKS - half]})
    positive = positive + [disguised(s) for s in positive if ORDER + 1 < len(s) < LONGEST]
    strings = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    values, vectors = np.linalg.eigh(similarities(landmarks, landmarks))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    weight = np.where(y > 0, 20.0 * max(1.0, len(negative) / max(1, len(positive))) ** 0.5, 20.0)
    w = squared_hinge(similarities(strings, landmarks) @ root, y, weight)
    beta = root @ w[:-1] / np.sqrt(own_kernels(landmarks))
    alphabet = "".join(sorted(set("".join(landmarks))))
    machine = Machine(alphabet, np.zeros((len(alphabet) + 1,) * ORDER), float(w[-1]), np.zeros(TOP + 1))
    for z, b in zip(landmarks, beta, strict=True):
        i, j, k, decay = triples(len(z))
        ids = letter_ids(machine, codes([z]))[0]
        np.add.at(machine.weights, (ids[i], ids[j], ids[k]), b * decay)
    return machine


class Scorer:
    """Decisions of words, kept for a while."""

    def __init__(self, machine: Machine):
        self.machine, self.memo = machine, {}

    def tops(self, texts: list[str]) -> tuple[np.ndarray, list[set[str]]]:
        """The three highest decisions of every text (the bias where there are fewer), and the words."""
        words = [words_of(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        fresh = {w for ws in words for w in ws if w not in memo}
        strings, whose = [], []
        for w in fresh:
            memo[w] = self.machine.bias
            for s in strings_of(w):
                strings.append(s)
                whose.append(w)
        for w, d in zip(whose, decide(self.machine, strings).tolist(), strict=True):
            if d > memo[w]:
                memo[w] = d
        out = np.full((len(texts), TOP), self.machine.bias)
        for row, ws in enumerate(words):
            best = sorted([memo[w] for w in ws], reverse=True)[:TOP]
            out[row, : len(best)] = best
        return out, words


def chance(machine: Machine, tops: np.ndarray) -> np.ndarray:
    """The logistic curve over clipped decisions."""
    z = np.clip(tops, -2, 2) @ machine.curve[:-1] + machine.curve[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps; weights of the values are kept from being negative."""
    x, use = np.hstack((x, np.ones((len(x), 1)))), list(range(x.shape[1] + 1))
    while True:
        w = np.zeros(len(use))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w, -30, 30)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + np.eye(len(use)) * ridge
            step = np.linalg.solve(h, x[:, use].T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        down = [u for u, v in zip(use, w, strict=True) if v < 0 and u != x.shape[1] - 1]
        if not down:
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        use = [u for u in use if u not in down]


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and label (toxic) of at most `sample` documents of each label."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    toxic, clean = (known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (1, 0))
    # at most 2 * sample rows of two numbers
    chosen = F.broadcast(toxic.unionByName(clean))
    return docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string")).join(chosen, "doc_id").select("text", "toxic")


def _string_counts(sample: DataFrame) -> DataFrame:
    """string, and in how many distinct toxic and clean texts it is; near copies count once as a rule."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text.as_py())
                sign = min((xxhash.xxh3_64_intdigest(w) >> 1 for w in words), default=0)
                rows += [(s, y, sign) for s in {s for w in words for s in strings_of(w)}]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], ["s", "y", "sign"]
                )

    distinct = sample.mapInArrow(run, "s string, y int, sign long").distinct()
    return distinct.groupBy("s").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def _high_strings(clean: DataFrame, machine: Machine, least: float) -> DataFrame:
    """Strings of clean texts with a decision of at least `least`, and in how many texts each is."""

    def run(batches):
        scorer = Scorer(machine)
        for batch in batches:
            tops, words = scorer.tops(batch.column("text").to_pylist())
            found = [s for ws in words for w in ws if scorer.memo[w] >= least for s in strings_of(w)]
            value = decide(machine, found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(value, pa.float64())], ["s", "value"])

    return clean.select("text").mapInArrow(run, "s string, value double").groupBy("s").agg(F.max("value").alias("value"), F.count("*").alias("n"))


def _tops(sample: DataFrame, machine: Machine) -> DataFrame:
    def run(batches):
        scorer = Scorer(machine)
        for batch in batches:
            tops, _ = scorer.tops(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in tops.T), batch.column("toxic")], [*(f"t{i}" for i in range(TOP)), "toxic"])

    return sample.mapInArrow(run, ", ".join(f"t{i} double" for i in range(TOP)) + ", toxic int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine from `docs` (doc_id, text) and `labels` (doc_id, toxic), or None where nothing can be learned."""
    spark = docs.sparkSession
    read = stored(_sample(docs, labels, sample).repartition(16), folder(spark, "toxicity-sample"))
    sizes = {r.toxic: r.n for r in read.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    counts = stored(_string_counts(read), folder(spark, "toxicity-strings"))
    lift = F.col("toxic") / sizes[1] >= LIFT * F.col("clean") / sizes[0]
    often = counts.where((F.col("toxic") >= max(SUPPORT, SUPPORT_SHARE * sizes[1])) & lift)
    positive = [r.s for r in often.orderBy(F.desc("toxic"), "s").limit(POSITIVES).collect()]
    if not positive:
        return None
    plain = counts.where("toxic < 2 * clean").orderBy(F.xxhash64("s"), "s")
    negative = [r.s for r in plain.limit(NEGATIVES // 2).collect()]
    known = set(positive)
    machine = train(positive, negative)
    high = _high_strings(read.where("toxic = 0"), machine, -0.5).orderBy(F.desc("value"), "s").limit(NEGATIVES // 2)
    hard = [r.s for r in high.collect() if r.s not in known]
    machine = train(positive, hard[: LANDMARKS // 4] + [s for s in negative if s not in hard] + hard[LANDMARKS // 4 :])
    tops = _tops(read, machine).collect()  # at most 2 * sample rows of four numbers
    x = np.clip(np.array([r[:TOP] for r in tops]), -2, 2)
    y = np.array([float(r[TOP]) for r in tops])
    return machine._replace(curve=logistic(x, y))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        scorer = Scorer(machine) if machine else None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                values = chance(machine, scorer.tops(texts)[0]) if machine else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return remainder(doc_id, 4) == 2
