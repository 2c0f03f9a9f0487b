"""Near-duplicate classes, archives, line templates, personal data and the pipeline against plain Python."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from hourlake.llm import chosen_path, line_templates, pii, warc
from hourlake.llm.catalog import QUERIES
from hourlake.llm.common import folder
from hourlake.llm.components import components
from tests.llm import data


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return data.as_table(spark, tmp_path_factory.mktemp("structure") / "documents.parquet")


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7000, 7000 + i) for i in range(300)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {(x.node, x.root) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, u.root(n)) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_near(rows):
    """(doc_id, class_id, class_size, n_copies, n_links) of every row; class members by position."""
    sets = [shingles(r.text) for r in rows]
    worded = [tuple((r.text or "").encode().split()) for r in rows]
    copies = Counter(w for w in worded if w)
    u, links, firsts = Union(), Counter(), {}
    for i, w in enumerate(worded):
        u.root(i)
        if w:
            u.join(firsts.setdefault(w, i), i)
    reps = list(firsts.values())
    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared * 10 >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                links[worded[a]] += 1
                links[worded[b]] += 1
                u.join(a, b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[u.root(i)].append(i)
    out = []
    for i, r in enumerate(rows):
        group = members[u.root(i)]
        ids = [rows[k].doc_id for k in group if rows[k].doc_id is not None]
        out.append((r.doc_id, min(ids) if ids else None, len(group), copies.get(worded[i], 1), links[worded[i]]))
    return Counter(out), len(members)


@pytest.mark.parametrize("how", [{}, {"small": 2, "depth": 3, "block": 3}])
def test_near_classes(docs, how):
    got = chosen_path.near_classes(docs, **how).collect()
    want, classes = brute_near(docs.collect())
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_copies, r.n_links) for r in got) == want
    assert sum(r.kept for r in got) == classes
    kept = chosen_path.keep_one(docs, **how)
    assert kept.columns == docs.columns and kept.count() == classes


def test_recall_near_the_threshold(spark, tmp_path):
    """Pairs just above 0.8 are found, pairs just below are not."""
    rows, want = [], {}
    for k in range(120):
        words = data.words(1000 + k, 300)
        other = words[:]
        # each replaced word breaks five of 296 shingles
        for i in range(6 + (k % 4) if k % 4 < 3 else 7):
            other[10 + 40 * i if i < 7 else 5] = f"new{k}x{i}"
        a, b = (2 * k, " ".join(words)), (2 * k + 1, " ".join(other))
        rows += [a, b]
        x, y = shingles(a[1]), shingles(b[1])
        want[2 * k] = len(x & y) / len(x | y) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.n_links for r in chosen_path.near_classes(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert 20 < sum(want.values()) < 120 or set(want.values()) == {True}
    assert [got[i] == got[i + 1] == int(alike) for i, alike in want.items()].count(False) == 0


def test_runs_reach_the_recall():
    runs = chosen_path.runs_for(0.999, 0.8, 3)
    assert (1 - chosen_path.survival(0.8, 3)) ** runs <= 0.001


def page_rows():
    big, shared = "<p>" + "é" * 700 + "</p>", "<html>" + "same " * 300 + "</html>"
    rows = [(i, f"https://www.site{i % 5}.example.com:443/a/{i}?b=2&a=1", f"<html>{data.prose(i, 200)}</html>") for i in range(60)]
    rows += [(100 + i, f"http://copy.example.org/{i}", shared) for i in range(40)] + [(200 + i, "http://same.example.net/", big) for i in range(5)]
    rows += [(300, None, "x"), (301, "no url at all \n", "x"), (302, "http://[bad", "WARC/1.1\r\n\r\n"), (303, "http://e.example/", None), (304, "http://e.example/", "")]
    rows += [(305, "http://exämple.com/ü x", big + "y"), (305, "http://exämple.com/ü x", big + "y"), (None, "http://n.example/", shared), (-7, "http://m.example/", "small"), (None, None, None)]
    return rows


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("line", F.lit(1)).withColumn("payload", F.lit("z"))
    pages.repartition(4).write.parquet(str(tmp_path / "p"))
    got = warc.round_trip(spark.read.parquet(str(tmp_path / "p"))).collect()
    largest = defaultdict(list)
    for i, _, h in page_rows():
        largest[h or ""].append(i)
    want = Counter()
    for i, _, h in page_rows():
        data_ = (h or "").encode()
        known = [x for x in largest[h or ""] if x is not None]
        top = max(known) if known and len(data_) >= 1000 and len(largest[h or ""]) > 1 else i
        want[i, len(data_), hashlib.sha1(data_).hexdigest(), "response" if top == i else "revisit", None if top == i else top] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {(r.page_id, r.payload) for r in got if r.record_type == "response"} <= {(i, h or "") for i, _, h in page_rows()}


def test_index_finds_what_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "KEY_BYTES", 12)  # cut keys share directory entries
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    at = folder(spark, "warc-test")
    blocks = warc.build_index(warc.write_archives(pages, at), at, lines=4)
    assert blocks.count() > 20
    wanted = ["http://same.example.net/", "https://site3.example.com/a/3?a=1&b=2", "http://nowhere.example/"]
    keys = spark.createDataFrame([(warc.url_key(u),) for u in wanted + wanted], "key string")
    found = warc.read_records(warc.search(blocks, keys), at).collect()
    assert sorted(r.page_id for r in found) == [3, 200, 201, 202, 203, 204]
    # every file is a plain sequence of gzip members that starts with a record
    store, root = warc.store_of(at)
    files = store.get_file_info(fs.FileSelector(f"{root}/archives"))
    assert files and all(gzip.decompress(store.open_input_stream(f.path, compression=None).read()).startswith(b"WARC/1.1\r\n") for f in files if f.size)
    with pytest.raises(ValueError):
        warc.directory(blocks, entries=5)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.com/B?z=1&a=2#top") == "com,example)/b?a=2&z=1"
    assert warc.url_key("http://a.b.example:8080") == "example,b,a:8080)/"
    assert warc.url_key(None) == warc.url_key("") and " " not in warc.url_key("a b\nc")


def test_line_templates(spark, tmp_path):
    stamp = lambda i: f"Released by the {['north', 'south', 'east', 'west'][i % 4]} team on day {i} of the long hot year"
    texts = [(i, data.prose(i) + "\n" + stamp(i) + "\nshort one\n" + data.prose(500 + i, 24)) for i in range(30)]
    texts += [(100 + i, data.prose(900)) for i in range(20)] + [(200, None), (201, ""), (None, stamp(3)), (203, "\n".join(stamp(i) for i in range(20)))]
    texts += [(204, "\n".join(f"entry {i} of one list of many things" for i in range(50)))]
    docs = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, line string, dropped string")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in line_templates.decisions(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        lines = (t or "").split("\n")
        want = [k for k, x in enumerate(lines) if x.startswith("Released by")]
        assert got[i].n_lines == len(lines) and got[i].dropped == ",".join(map(str, want)) and got[i].n_dropped == len(want)
    clean = line_templates.without_recurring(docs)
    assert clean.columns == docs.columns
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(after[i] == ("\n".join(x for x in t.split("\n") if not x.startswith("Released by")) if t else t) for i, t in texts)
    assert line_templates.decisions(data.empty(spark)).count() == 0


def test_many_templates_behind_one_start(spark, tmp_path):
    """A field's words are in more lines of the leaf than the words of any one template; views tell them apart."""
    line = lambda k, i: f"all of them word{chr(97 + k)} {chr(97 + k) * 4} end of field{chr(97 + i)} line {k * i}"
    texts = [(i, "\n".join([line(k, i) for k in range(20)] + [f"all of them {' '.join(data.words(i, 7))}"])) for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = line_templates.decisions(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert [r.dropped for r in got] == [",".join(map(str, range(20)))] * 12


def test_field_right_after_the_leading_words(spark, tmp_path):
    """The names stand in the words that follow the leaf's key, each in one text."""
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) + "son" for i in range(400)]
    texts = [(i, f"{data.prose(i, 24)}\nPosted in category by {x}\nwas written by {x}") for i, x in enumerate(names)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert {r.dropped for r in line_templates.decisions(spark.read.parquet(str(tmp_path / "d"))).collect()} == {"2,3"}


def test_short_lines_of_the_query(spark, tmp_path):
    """Lines of one to three words fall if they recur as they are; lines that are alike but for a field stay, so do empty ones."""
    texts = [(i, f"{data.prose(i, 24)}\nAll rights  reserved.\n\nMenu\nPage {i}\n{i}\n{data.words(i, 1)[0]}{i} x") for i in range(12)]
    docs = spark.createDataFrame([*texts, (50, "Menu\nonce"), (51, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.dropped for r in QUERIES["op1_template_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: "2,4" for i in range(12)} | {50: "0", 51: ""}


def plain_templates(texts: list[str], least: int, often: int = 10) -> list[str]:
    """Dropped lines of each text, from the definition of weights, templates and views, by loops over words."""
    words, where, times = {}, {}, {}
    for t in texts:
        for line in t.split("\n"):
            w = line.split()
            if len(w) >= 4:
                w = ["<*>" if any(c.isdigit() for c in x) else x for x in w]
            if len(w) >= max(least, 1):
                key = words[line] = tuple(w)
                where.setdefault(key, set()).add(t)
                times[key] = times.get(key, 0) + 1

    def found(seen: list[tuple]) -> tuple[set, set]:
        """Lines with templates and lines with recurring ones, of (line, view) pairs."""
        weight, templates, held = {}, set(), {}
        for line, view in seen:
            for p in range(len(line)):
                weight[view, p, line[p]] = weight.get((view, p, line[p]), 0) + times[line]
        for line, view in seen:
            lead = min(3, len(line))
            total = sum(times[x] for x in by_view[view])
            ws = [total if p < lead else weight[view, p, x] for p, x in enumerate(line)]
            need = len(line) if len(line) < 4 else math.ceil(0.75 * len(line))
            for level in {w for w in ws if w >= often}:
                stay = tuple(x if w >= level else None for x, w in zip(line, ws, strict=True))
                if len(line) - stay.count(None) >= need:
                    templates.add((line, view, stay))
                    held.setdefault((view, stay), set()).update(where[line])
        return {x for x, *_ in templates}, {x for x, *t in templates if len(held[tuple(t)]) >= often}

    def pairs(views) -> list[tuple]:
        by_view.clear()
        for line, view in views:
            by_view.setdefault(view, []).append(line)
        return [(x, view) for view, lines in by_view.items() if sum(times[y] for y in lines) >= often for x in lines]

    by_view: dict = {}
    some, out = found(pairs((x, (len(x), x[:3])) for x in where))
    views = []
    for x in some - out:
        parts = max(1, min(8, len(x) - math.ceil(0.75 * len(x)) + 1, len(x) - 3))
        for part in range(parts if len(x) > 3 else 0):
            mine = [p for p in range(3, len(x)) if (p - 3) * parts // (len(x) - 3) == part]
            views.append((x, (len(x), x[:3], part, tuple(x[p] for p in mine))))
    out |= found(pairs(views))[1]
    return [",".join(str(k) for k, x in enumerate(t.split("\n")) if words.get(x) in out) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_template_query_by_brute_force(spark, tmp_path, seed, monkeypatch):
    """Overlapping random templates of all lengths; the same rows whether words are joined by a broadcast or a shuffle."""
    r = random.Random(seed)
    frames = [[r.choice("abcdefgh") for _ in range(r.choice((1, 2, 3, 4, 5, 6, 9, 13)))] for _ in range(30)]
    def line():
        w = ["x", "y", "z"][: r.randint(0, 3)] + list(r.choice(frames))
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = r.choice("abcdefgh") * r.randint(1, 2) + r.choice(("", "", "7"))
        return " ".join(w)
    texts = ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(250)] + ["", "\n\n", "a b c\na b c"] + ["x y z a b"] * 12
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_templates(texts, 1)
    for hot in (line_templates.HOT, 1.0, 0.0):
        monkeypatch.setattr(line_templates, "HOT", hot)
        got = {x.doc_id: x.dropped for x in QUERIES["op1_template_line_dedup"](spark, str(tmp_path)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 100 and "" in want[:250]


RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in RAW for m in re.finditer(RAW[k], text or "") if good(k, m.group())]


def kind_of(v):
    """The kind whose base pattern matches all of `v`, else that of a digest, else none."""
    if "\n" not in v:
        for k in RAW:
            if re.fullmatch(RAW[k], v) and (k, 0, len(v)) in base_spans(v):
                return k
    return "secret" if re.fullmatch("[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", v) and re.search("[a-f]", v) and re.search("[0-9]", v) else None


def plain_spans(texts):
    """All spans of every text, by the graph over whole texts in plain Python."""
    held = []  # text, kind, start, end, v, pattern
    for i, text in enumerate(texts):
        text = text or ""
        hits = list(re.finditer(pii.CANDIDATE, text, re.ASCII))
        for k, m in enumerate(hits):
            v = re.sub(pii.HEAD, "", m.group(), count=1)
            start = m.end() - len(v)
            v = re.sub(pii.TAIL, "", v)
            if not v:
                continue
            before = text[hits[k - 1].start() if k else 0 : m.start()]
            after = text[m.end() : hits[k + 1].end() if k + 1 < len(hits) else len(text)]
            two = re.sub("[0-9]+", "#", " ".join(before.split()[-2:])).lower() if before.isascii() else None
            nxt = re.sub("[0-9]+", "#", (after.split() or [""])[0]).lower() if after.isascii() else None
            if two is None:
                two = re.sub("[0-9]+", "#", " ".join(re.split(r"[ \t\n\x0b\f\r]+", before.strip(" \t\n\x0b\f\r"))[-2:])).lower()
            if nxt is None:
                nxt = re.sub("[0-9]+", "#", re.split(r"[ \t\n\x0b\f\r]+", after.strip(" \t\n\x0b\f\r"))[0]).lower()
            one = two.split(" ")[-1]
            patterns = {f"B {one} _ {nxt}"} | ({f"L {two} _"} if " " in two else set()) | ({f"N _ {nxt}"} if nxt else set())
            if two:
                patterns |= {f"P {one} _", f"S {re.sub(r'[^\W\d]+', 'a', two)} _"}
            held += [(i, kind_of(v), start, start + len(v), v, p) for p in patterns]
    instances = defaultdict(dict)
    for _, kind, _, _, v, p in held:
        instances[p][v] = kind
    suits = {
        "email": lambda v: "@" in v, "ip": lambda v: re.fullmatch("[0-9]+([.:][0-9]+)+", v), "card": lambda v: re.fullmatch("[0-9 -]+", v) and len(re.sub("[^0-9]", "", v)) >= 12,
        "phone": lambda v: re.fullmatch("[+0-9 ().-]+", v) and 7 <= len(re.sub("[^0-9]", "", v)) <= 15,
        "secret": lambda v: re.fullmatch("[A-Za-z0-9_+/=.-]{16,}", v) and re.search("[0-9]", v) and re.search("[A-Za-z]", v),
    }
    believed = {}
    while True:
        counting = {}
        for p, vs in instances.items():
            for kind in suits:
                backing = sum(1.0 if seed == kind else believed.get((v, kind), 0.0) if seed is None else 0.0 for v, seed in vs.items())
                if backing >= 5 and backing / (len(vs) + 2) >= 0.8:
                    counting[p, kind] = backing / (len(vs) + 2)
        now = defaultdict(lambda: 1.0)
        for (p, kind), confidence in counting.items():
            for v, seed in instances[p].items():
                if seed is None and suits[kind](v):
                    now[v, kind] *= 1 - confidence
        now = {k: 1 - x for k, x in now.items()}
        still = all(x - believed.get(k, 0.0) <= 0.001 for k, x in now.items())
        believed = now
        if still:
            break
    best = {}
    for (v, kind), x in sorted(believed.items(), key=lambda e: (-e[1], e[0][1])):
        if x >= 0.9:
            best.setdefault(v, kind)
    out = [set(base_spans(t)) for t in texts]
    for i, kind, a, b, v, p in held:
        kind = "secret" if kind == "secret" else best.get(v) if kind is None else None
        if kind and (p, kind) in counting and not any(s < b and a < e for _, s, e in base_spans(texts[i])):
            out[i].add((kind, a, b))
    return [",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=lambda m: ([*RAW, "secret"].index(m[0]), m[1]))) for x in out]


def test_personal_data(spark, docs, tmp_path):
    r = random.Random(5)
    parts = ["a", "b.", "@", "1", "25", ".", " ", "-", "+", "(", "_", "é", "\U0001f600", "4111111111111111", "192.168.1.1", "x@y.z", "\n", "%", "0256", "+1 (555) 123-4567"]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(400)]
    texts += [(5000, "1" * 20_000), (5001, "a" * 60_000 + "@"), (5002, "1.2.3.4." * 500), (5003, "+" * 3000 + "1(2)" * 2000), (5004, "a@b.c_" * 500), (5005, None), (5006, "")]
    cards, k = [], 4_000_000_000_000_000
    while len(cards) < 40:
        k += 7919
        if luhn(str(k)):
            cards.append(str(k))
    contexts = [f"Please charge my old card {c} before the month ends" for c in cards]
    texts += [(6000 + i, t) for i, t in enumerate(contexts)] + [(7000, "Please charge my old card 4000000000000001 before the month ends"), (7001, "on card 4000000000000001, yes")]
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(130)]
    texts += [(9000 + i, f"word{'s' * i} api_key: '{h}' end{'x' * i}") for i, h in enumerate(hexes[:120])]
    texts += [(8100, "here api_key: 'Zx9-unseen_Key.0042' stands"), (8101, "API_KEY: " + "F0" * 20), (8102, "alone " + hexes[125] + " here"), (8103, "api_key: 12")]
    texts += [(8200 + i, f"Call the desk at +1 (555) 010-{i:04d} now") for i in range(40)] + [(8300, "Call the desk at (826) 555-7388 now"), (8301, "Call the desk at " + "long" * 40 + "1 now")]
    # a chain: the second context holds only identifiers that the first one found
    texts += [(8400 + i, f"api_key: k{'q' * i}-00000000000000{i}x x ; rotate {'z' * 60} k{'q' * i}-00000000000000{i}x") for i in range(20)] + [(8500, f"rotate {'z' * 60} Tail-7777777777777777")]
    spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, place string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = pii.find(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(got) == len(texts)
    by_id = dict(texts)
    for x in got:
        spans = base_spans(by_id[x.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in spans) for k in RAW]
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))
    want = dict(zip(by_id, plain_spans(list(by_id.values())), strict=True))
    assert {x.doc_id: x.spans for x in got} == want
    assert all(x.n_found == len(x.spans.split(",")) * (x.spans != "") - len(base_spans(by_id[x.doc_id])) for x in got)
    assert want[7000] == "card:26:42" and want[7001] == "card:8:24"  # fails its check digit, but stands where cards stand
    assert want[9000] == "secret:15:55" and want[8100] == "secret:15:34" and want[8101] == "secret:9:49"
    assert want[8102] == want[8103] == "" and want[8300] == "phone:17:31" and want[8301] == ""
    assert want[8500] == "secret:68:89"
    assert pii.find(docs).count() == docs.count()
    assert pii.find(data.empty(spark)).count() == 0


LABELS = "doc_id long, quality int, toxic int"


def test_pipeline_stages(spark, docs, tmp_path):
    rows = docs
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert not Counter(map(tuple, new.collect())) - Counter(map(tuple, rows.collect())), name
        if name == "near_dedup":
            assert new.count() == brute_near(rows.collect())[1]
        rows = new
    assert rows.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    data.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
