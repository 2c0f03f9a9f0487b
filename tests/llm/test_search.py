"""Hard negatives, ranked search and repeated windows against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourlake.llm import debruijn, hard_negatives, ranked_search
from tests.llm import data

ROW = "vec_id long, embedding array<float>, label int, score string, tile string"


def vectors() -> list[tuple]:
    """Clumps, lone vectors, ties, repeated rows, short, zero, null and non-finite ones."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 6))
    out = []
    for i in range(260):
        x = centres[i % 4] + 0.1 * r.normal(size=6) if i % 3 else r.normal(size=6)
        x = x / np.linalg.norm(x)
        out.append((i, [float(v) for v in x], int(r.integers(0, 4))))
    out += [(300, out[9][1], 1), (301, out[9][1], 1), (302, out[9][1], 2), out[9], out[0], out[0]]  # ties and repeated rows
    out += [(400, [0.0] * 6, 1), (500, [0.5, 0.5], 2), (501, [], 2), (503, None, 1), (504, out[3][1], None), (None, out[9][1], 3), (None, None, None)]
    out += [(600, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (601, [float("nan")] * 6, 1), (602, [float("inf")] + [0.0] * 5, 2), (700, out[4][1], 9)]
    return [(*x, "s", None) for x in out]


def brute_negatives(rows, every=100):
    usable = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        usable.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))
    rank = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = Counter()
    for a, (vec_id, x, label) in enumerate(usable):
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=False)), i, m) for b, (i, y, m) in enumerate(usable) if b != a]
        good = sorted((c for c in scored if c[2] == label), key=rank)[:5]
        bad = sorted((c for c in scored if c[2] != label), key=rank)
        for s, p, _ in good:
            fit = [c for c in bad if 80 * s <= 100 * c[0] <= 100 * s][:5]
            out.update((vec_id, p, k, i, s, t) for k, (t, i, _) in enumerate(fit, 1))
    return out


@pytest.mark.parametrize(("tile", "members", "every"), [(16, 1, 100), (64, 8, 10), (2048, 32, 100)])
def test_hard_negatives(spark, tile, members, every):
    rows = vectors()
    got = hard_negatives.mine(spark.createDataFrame(rows, ROW).repartition(3), F.col("vec_id") % every == 0, tile=tile, members=members)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, every)


def test_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, [0.5], 1, "", "")], [(100, None, 1, "", "")], [(100, [0.5], 1, "", "")]):
        assert hard_negatives.mine(spark.createDataFrame(rows, ROW), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(1 << (20 + i % 3)), float(i)], i % 2, "", "") for i in range(40)]
    got = hard_negatives.mine(spark.createDataFrame(rows, ROW), F.col("vec_id") % 10 == 0, least=(80, 100))
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_no_bound_is_below_a_score():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(500, 5))).astype(np.int32)
    centre = hard_negatives.centroids(x[:50], 7)
    unit, norm = hard_negatives.directions(x)
    angle = hard_negatives.angles(unit, norm, centre)
    home = angle[:50].argmin(axis=1)
    radius = np.zeros(7)
    np.maximum.at(radius, home, angle[np.arange(50), home])
    bound = hard_negatives.bounds(angle, norm, radius)
    for a in range(50):
        assert (norm[a] * bound[:, home[a]] >= x @ x[a]).all()


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=20):
    docs = [(d, Counter(plain_terms(t))) for d, t in docs]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n, length = len(docs), sum(m for _, _, m in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c, m in docs:
            norm = 75 + 25 * m * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * norm)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[item, rank, d, -s] += 1
    return out


ITEM = "item_id long, text string, doc_id string, n string, score string"


@pytest.mark.parametrize(("block", "size", "k"), [(8192, 4 << 20, 20), (16, 4 << 20, 3), (7, 60, 20)])
def test_ranked_search(spark, block, size, k):
    texts = [(r[0], r[1]) for r in data.rows()]
    texts += [(500 + i, "Zebra zebra " + "x9 " * i) for i in range(30)] + [(600, "ÄÖ ÄÖ'straße K"), (601, "äö zebra"), (-5, "zebra")]
    r = random.Random(3)
    items = [(i, " ".join(r.choices(data.words(r.randrange(40), 120), k=20))) for i in range(12)]
    items += [(20, "zebra"), (21, "ÄÖ straße zebra zebra"), (22, None), (23, ""), (24, "never seen"), (None, "zebra x9"), (20, "zebra"), (25, data.prose(1)), (26, "one two three")]
    docs = spark.createDataFrame([(i, t, "l", "s", 0, "", "", "", "") for i, t in texts], data.SCHEMA).repartition(4)
    got = ranked_search.search(docs, spark.createDataFrame([(i, t, "", "", "") for i, t in items], ITEM), k=k, block=block, size=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(texts, items, k)


def test_search_in_empty_tables(spark):
    items = spark.createDataFrame([(1, "a", "", "", "")], ITEM)
    some = spark.createDataFrame([(1, "a", "l", "s", 0, "", "", "", "")], data.SCHEMA)
    for docs, asked in ((data.empty(spark), items), (some, items.limit(0)), (data.empty(spark), items.limit(0)), (some.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        assert ranked_search.search(docs, asked).count() == 0


def test_accumulators_are_limited():
    """Once k partial scores lie above what is left, no further accumulator is made; survivors stay exact."""
    rare, common = np.arange(5), np.arange(1000)
    rows, starts = np.concatenate((rare, common)), np.array([0, 5, 1005])
    gains = np.concatenate((np.full(5, 100), np.full(1000, 3)))
    found, scores = ranked_search.accumulate([(0, 1), (1, 2)], starts, rows, gains, np.array([100, 3]), 1000, 5, 0)
    assert found.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [106] * 5
    found, _ = ranked_search.accumulate([(0, 1), (1, 2)], starts, rows, gains, np.array([100, 3]), 1000, 6, 0)
    assert len(found) == 1000
    assert len(ranked_search.accumulate([(1, 1)], starts, rows, gains, np.array([100, 3]), 1000, 5, 4)[0]) == 0


def brute_windows(rows, size=13):
    words = [(d, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages() -> list[tuple]:
    """Texts with shared passages that start, end, nest and overlap in many ways."""
    r = random.Random(8)
    pool = [data.words(50 + i, 70) for i in range(6)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.randint(0, 40)
            parts += p[a : a + r.randint(5, 60)] + data.words(1000 + r.randrange(10**6), r.randint(0, 9))
        out.append((r.randint(1000, 1040), r.choice((" ", "\n", " \t")).join(parts)))
    loop = " ".join(["ha", "hi"] * 40)
    return out + [(2000, loop), (2001, loop + " ho"), (2002, "ha " * 200), (2003, "ha " * 100), (999, "a\x1cb\x00 " * 30), (1000, "a\x1cb\x00  " * 30)]


@pytest.mark.parametrize(("window", "piece"), [(13, 6), (13, 13), (5, 2), (13, 1)])
def test_repeated_windows(spark, tmp_path, window, piece):
    rows = [(r[0], r[1]) for r in data.rows()] + passages()
    docs = data.as_table(spark, tmp_path / "documents.parquet", [(d, t, "l", "s", 0, "", "", "", "") for d, t in rows])
    got = debruijn.without_repeats(docs, window, piece)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_windows(rows, window)


def test_no_documents_no_windows(spark):
    assert debruijn.without_repeats(data.empty(spark)).count() == 0


def test_paths_are_compacted(spark, tmp_path):
    """A passage in many documents is one path, not one row a window."""
    shared = data.words(7, 400)
    rows = [(i, " ".join([*data.words(100 + i, 30), *shared, *data.words(300 + i, 30)])) for i in range(20)]
    docs = data.as_table(spark, tmp_path / "documents.parquet", [(d, t, "l", "s", 0, "", "", "", "") for d, t in rows])
    keyed = debruijn._keyed(docs)
    every = debruijn._minimizers(keyed, 13, 6)
    lists = every.groupBy("place").agg(F.collect_list("minimizer").alias("minimizers"))
    stretches = debruijn._stretches(keyed.join(lists, "place"), 13, 6)
    heads, _ = debruijn.compacted(stretches.drop("windows"), str(tmp_path / "at"))
    spans = [r.span for r in heads.collect()]
    assert len(spans) == 1 and 350 < spans[0] <= 388


def test_word_hashes_do_not_depend_on_the_place():
    reader = debruijn.Reader()
    texts = [b"one two  three", b"", b"\tthree\none ", b"two" * 3000 + b" one"]
    owner, h, other = reader.words(texts)
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3]
    seen = defaultdict(set)
    for w, a, b in zip(" ".join(t.decode() for t in texts).split(), h.tolist(), other.tolist(), strict=True):
        seen[w].add((a, b))
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)
