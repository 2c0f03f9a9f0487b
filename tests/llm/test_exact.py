"""Exact dedup and mixing against plain Python, compression bands against the definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from hourlake.llm import compression, exact_dedup, mixing
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return data.as_table(spark, tmp_path_factory.mktemp("exact") / "documents.parquet")


@pytest.mark.parametrize("heavy", [1, 1000])
def test_groups_of_equal_texts(docs, heavy):
    got = exact_dedup.groups(docs, counters=4096, heavy=heavy).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.text or ""].append(r.doc_id)
    want = Counter()
    for text, ids in texts.items():
        sha, known = hashlib.sha256(text.encode()).hexdigest(), [i for i in ids if i is not None]
        want.update((i, max(known) if known else None, len(ids), sha) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(texts) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("heavy", [1, 1000])
def test_one_row_of_each_text_stays_unchanged(docs, heavy):
    kept = exact_dedup.keep_one(docs, counters=4096, heavy=heavy)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r.text or "" for r in docs.collect()})
    assert not Counter(map(tuple, rows)) - Counter(map(tuple, docs.collect()))


def brute_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs):
    odd = [(900 + i, t, None, None, None, "", "", "", "") for i, t in enumerate(["a\x1cb c\x85d\xa0e", "a b c a b c a b c", "x\n\nx\n x\r\nx", "#|<é> $", "a a a a"])]
    both = docs.unionByName(data.documents(spark, odd))
    texts = defaultdict(set)
    for r in both.collect():
        texts[r.doc_id].add(r.text)
    for r in compression.judge(both).collect():
        counts = tuple(r[c] for c in compression.COUNTS)
        assert counts in {brute_counts(t) for t in texts[r.doc_id]}
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise():
    tool = zstandard.ZstdCompressor(level=compression.LEVEL)
    noise = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(300))
    coded = "".join(chr(33 + int(noise[i : i + 4], 16) % 94) for i in range(0, 36_000, 4))
    assert compression.in_bands(data.prose(3, 400).encode(), tool)[0]
    assert compression.in_bands(data.prose(3, 40_000).encode(), tool)[0]
    assert not compression.in_bands(("buy cheap pills " * 500).encode(), tool)[0]
    assert not compression.in_bands(coded.encode(), tool)[0]
    assert not compression.in_bands(b"", tool)[0]


def test_bands_reject_random_letters_and_half_junk():
    """Words of random characters, where prose of that length is told from them, and prose with a half or third of encoded words."""
    tool, r = zstandard.ZstdCompressor(level=compression.LEVEL), random.Random(11)
    lower = "abcdefghijklmnopqrstuvwxyz"
    mixed, digits = lower + lower.upper() + "0123456789+/", "0123456789abcdef"

    def junk(letters, n):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(n // 4))[:n].encode()

    for letters, sizes in ((mixed, (700, 1000, 3000, 20_000)), (lower, (2000, 3000, 5000, 20_000)), (digits, (6000, 20_000))):
        assert not any(compression.in_bands(junk(letters, n), tool)[0] for n in sizes for _ in range(5))
    prose = data.prose(3, 4000).encode()
    for n in (3000, 5000, 20_000):
        assert compression.in_bands(prose[:n], tool)[0]
        assert not compression.in_bands(prose[: n // 2] + b"\n" + junk(mixed, n // 2), tool)[0]
    assert not compression.in_bands(prose[:8000] + b"\n" + junk(mixed, 4096), tool)[0]
    # syllables of three bytes
    korean = " ".join("".join(chr(0xAC00 + min(int(r.expovariate(1 / 900)), 11_000)) for _ in range(r.randint(2, 5))) for _ in range(400))
    assert compression.in_bands(korean.encode(), tool)[0]


def test_learned_limits_against_plain_lines(spark):
    """kept of every row, with limits learned from labels, equals a plain least-squares line per cell; junk that the base passes falls."""
    r = random.Random(2)
    good = [(i, data.prose(i, r.randint(120, 900))) for i in range(160)]
    marked = [(1000 + i, " ".join(w + r.choice(("%%%", "&&&", "###")) for w in data.prose(500 + i, r.randint(150, 900)).split())) for i in range(30)]
    rows = [*good, *marked, (2000, None), (2001, ""), (3000, good[0][1]), (3000, good[0][1]), (None, good[1][1])]
    docs = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, kept boolean").repartition(5)
    pairs = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in marked] + [(7, 0), (None, 1), (9, None), (11, 1)]
    labels = spark.createDataFrame([(*p, 0) for p in pairs], "doc_id long, quality int, text int")
    limits = compression.fit(docs, labels)
    tool, points = zstandard.ZstdCompressor(level=compression.LEVEL), {}
    for i, text in good:
        if zlib.crc32(str(i).encode()) % 4 != 2 and i not in (7, 9) and brute_counts(text)[0] >= 50:
            whole, chunks = compression.compressed_shares(text.encode(), tool)
            for is_whole, part, share in [(True, text.encode(), whole), *[(False, *c) for c in chunks]]:
                several = sum(b > 127 for b in part) / len(part)
                points.setdefault((is_whole, int(2 * math.log2(len(part))), int(4 * several)), []).append((math.log2(len(part)), share))
    points = {k: v for k, v in points.items() if len(v) >= compression.ENOUGH}
    assert set(limits) == set(points) and len(points) >= 3
    for key, found in points.items():
        x, y = np.array(found).T
        slope, start = np.polyfit(x, y, 1) if np.ptp(x) > 1e-6 else (0.0, y.mean())
        depth = (3.0 if key[0] else 2.5) * float(np.sqrt(np.mean((y - start - slope * x) ** 2)))
        assert np.allclose(limits[key], (start, slope, depth), atol=1e-6)
    got = Counter((x.doc_id, x.kept) for x in compression.judge(docs, limits).collect())
    want = Counter()
    for i, text in rows:
        data_ = (text or "").encode()
        keep = bool(data_) and not (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(brute_counts(text))
        if keep:
            whole, chunks = compression.compressed_shares(data_, tool)
            out = [outside(p, s, compression.CHUNKS, False, limits) for p, s in chunks]
            bad, noisy = sum(o != 0 for o in out), sum(o > 0 for o in out)
            keep = outside(data_, whole, compression.WHOLE, True, limits) == 0 and 2 * bad <= len(out) and 4 * noisy <= len(out)
        want[i, keep] += 1
    assert got == want
    assert sum(n for (i, k), n in got.items() if k and i is not None and i < 1000) >= 155
    assert sum(n for (i, k), n in got.items() if not k and i is not None and 1000 <= i < 2000) >= 25
    assert compression.fit(docs, labels.limit(0)) == {} == compression.fit(docs.limit(0), labels)


def outside(part, share, bands, is_whole, limits):
    below, least, most = next(b for b in bands if len(part) < b[0])
    several = sum(b > 127 for b in part) / len(part)
    line = limits.get((is_whole, int(2 * math.log2(len(part))), int(4 * several)))
    if line:
        least = max(least, line[0] + line[1] * math.log2(len(part)) - line[2])
    return 1 if share > most + compression.ROOM * several else -1 if share < least else 0


def test_good_rows_stay_unchanged(docs):
    kept = compression.keep_good(docs)
    assert kept.columns == docs.columns
    rows = Counter(map(tuple, kept.collect()))
    assert rows and not rows - Counter(map(tuple, docs.collect()))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} >= set(range(40))


def fill(children, budget):
    """Shares by raising the level until the budget is spent: children are (name, weight, capacity)."""
    open_, out = sorted(children), {}
    budget = min(budget, sum(c for _, _, c in children))
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [x for x in open_ if x[2] * total <= budget * x[1]]
        if not full:
            floors = {n: budget * w // total for n, w, _ in open_}
            order = sorted(open_, key=lambda x: (-(budget * x[1] % total), x[0]))
            for n, _, _ in order[: budget - sum(floors.values())]:
                floors[n] += 1
            return out | floors
        # the one that fills first
        first = min(full, key=lambda x: (x[2] / x[1], x[0]))
        out[first[0]] = first[2]
        budget -= first[2]
        open_.remove(first)
    return out


def brute_mix(rows, num, den, epochs, seed=mixing.SEED):
    leaves, members = Counter(), defaultdict(list)
    for r in rows:
        source, lang = r.source or "unknown", r.lang or "unknown"
        domain = {"0": "web", "1": "web", "2": "web", "3": "web", "4": "books", "5": "books", "6": "books"}.get(source[-1], "reference")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        leaves[domain, lang, source] += n
        members[domain, lang, source].append((r.doc_id, n))
    caps = {k: v * epochs for k, v in leaves.items()}
    under = lambda *p: sum(v for k, v in caps.items() if k[: len(p)] == p)
    out = Counter()
    tops = fill([(d, mixing.DOMAINS.get(d, 1), under(d)) for d in {k[0] for k in caps}], sum(leaves.values()) * num // den)
    for d, b in tops.items():
        for lang, b2 in fill([(x, mixing.LANGUAGES.get(x, 1), under(d, x)) for x in {k[1] for k in caps if k[0] == d}], b).items():
            for s, b3 in fill([(x, 1, caps[d, lang, x]) for x in {k[2] for k in caps if k[:2] == (d, lang)}], b2).items():
                tokens, docs = leaves[d, lang, s], members[d, lang, s]
                full, rest = divmod(b3, tokens) if tokens else (0, -1)
                at = lambda i, full=full: hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest()
                for i, n in docs:
                    used = sum(m for j, m in docs if at(j) <= at(i))
                    out[i, d, lang, s, n, tokens, b3, full + (used <= rest) if tokens else 0] += 1
    return out


@pytest.mark.parametrize("num,den,epochs", [(1, 2, 1), (3, 4, 3), (9, 10, 1), (5, 2, 3), (5, 1, 2), (1, 1000, 1)])
def test_mixture(docs, num, den, epochs):
    rows = docs.collect()
    got = mixing.mixed(docs, F.expr(f"total * {num} div {den}"), epochs, ).collect()
    assert Counter(map(tuple, got)) == brute_mix(rows, num, den, epochs)


def test_small_buckets_change_nothing(docs, tmp_path):
    one = mixing.stored(mixing.sized_rows(docs), str(tmp_path / "sized"))
    plans = [mixing.leaf_plan(one, F.expr("total * 2 div 3"), 1, bucket=b).select("source", "lang", "until", "full").collect() for b in (1, 3, 10**6)]
    assert sorted(plans[0], key=str) == sorted(plans[1], key=str) == sorted(plans[2], key=str)


def test_taken_rows(docs):
    taken = mixing.take(docs, F.expr("total * 2"), 3)
    assert taken.columns == docs.columns
    copies = Counter()
    for r in mixing.mixed(docs, F.expr("total * 2"), 3).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in taken.collect()) == +copies


def test_empty_tables(spark):
    none = data.empty(spark)
    for df in (exact_dedup.groups(none), exact_dedup.keep_one(none), compression.judge(none), compression.keep_good(none), mixing.mixed(none, F.expr("total"), 1), mixing.take(none, F.expr("total"), 2)):
        assert df.count() == 0
