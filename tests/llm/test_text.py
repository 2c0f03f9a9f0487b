"""Token ids against the library's own encoder, languages and toxicity on held-out rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hourlake.llm import bpe, language, toxicity
from hourlake.llm.catalog import QUERIES
from tests.llm import data

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ids, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aetion  \n\t's\x1c\x1f\x85\xa0é²½1")), max_size=60))
def test_ids_are_those_of_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_multilingual_vocabulary_and_full_memos(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "SEAMS", 50)
    enc = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN + "")
    lib = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ids, special_tokens={})
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["ing", "the", " ", "ä", "中", "文", "я", "приве", "\n", "qu", "er", "7"]) for _ in range(80))
        assert enc.encode(text) == lib.encode_ordinary(text)


def test_long_pieces_take_linear_time(encoder, library):
    for text in ("a" * 30_000, " " * 30_000, "theing" * 5000, "\U0001f600" * 3000):
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text.encode()
    short = "theing" * 40
    assert encoder.encode(short) == library.encode_ordinary(short)


def test_query_columns_and_round_trip(spark, library, tmp_path):
    docs = data.as_table(spark, tmp_path / "d")
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    rows = bpe.encode_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = set()
        for t in texts[r.doc_id]:
            ids = library.encode_ordinary(t)
            want.add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.collect())
    assert bpe.encode_digests(data.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_ngram_vectors_bind_rotated_letters():
    s = language.Space(64, 3, 1)
    a, b, c = (s.letter(ord(x)) for x in "abc")
    gram = ord("a") << 42 | ord("b") << 21 | ord("c")
    assert (s.bind(gram) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    grams, counts = language.count_ngrams("Abc, abc1\U0001d504", 3)
    assert counts.sum() == len(" abc abc \U0001d504 ") - 2 and counts[list(grams).index(gram)] == 2


def test_language_on_held_out_rows(spark):
    got = QUERIES["op10_hyperdimensional_langid"](spark, DIR).toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = docs[docs.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97


def test_language_of_odd_rows(spark, tmp_path):
    docs = data.as_table(spark, tmp_path / "d")
    model = language.fit(docs)
    got = language.predict(docs, model).toPandas()
    assert len(got) == docs.count() and set(got.lang_pred) <= {"en", "de", "und"}
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "x"), (5, "中文")]
    answers = {r.doc_id: r for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [answers[i].lang_pred == "und" for i in range(1, 6)] == [True, True, True, False, False]
    none = language.fit(data.empty(spark))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none).collect()} == {("und", 0.0)}


def naive_kernel(s, t):
    """Sum over pairs of equal letter triples, by the definition."""
    d, out = toxicity.DECAY, 0.0
    ijk = [(i, j, k) for i in range(len(s)) for j in range(i + 1, len(s)) for k in range(j + 1, len(s))]
    lmn = [(i, j, k) for i in range(len(t)) for j in range(i + 1, len(t)) for k in range(j + 1, len(t))]
    for a in ijk:
        for b in lmn:
            if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                out += d ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
    return out


def test_kernel_and_folded_weights():
    r = random.Random(4)
    strings = ["".join(r.choice("abcd") for _ in range(r.randint(3, 8))) for _ in range(30)]
    for s, t in zip(strings, strings[1:], strict=False):
        got = toxicity.kernels(toxicity.codes([s]), toxicity.codes([t]))[0]
        assert got == pytest.approx(naive_kernel(s, t))
    near = toxicity.similarities(["idxiot", "potato"], ["idiot"])[:, 0]
    assert near[0] > 0.5 > 0.2 > near[1]


def test_disguised_insults():
    plain = sorted(set(data.words(8, 3000)))
    machine = toxicity.train(["idiot", "moron", "stupid"], plain)
    scorer = toxicity.Scorer(machine)
    values = scorer.tops(["you idiot", "i.d-i_o.t", "so i d i o t", "stuxpid", "the note"])[0][:, 0]
    assert (values[:3] > 0.5).all() and values[3] > values[4] + 0.5 and values[4] < -0.5


def test_toxicity_on_a_fixture(spark, tmp_path):
    texts = [(i, data.prose(i) + (" you moron and idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(None, None), (200, ""), (201, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(3, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    machine = toxicity.fit(docs.where("doc_id % 4 <> 2"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all(got[i] >= 0.3 for i, _, y in texts if y)
    assert sum(got[i] >= 0.3 for i, _, y in texts if not y) <= 2
    assert all(0 <= got[i] < 0.3 for i in (None, 200, 201))
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_query(spark):
    got = QUERIES["op2_subsequence_svm"](spark, DIR).toPandas()
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    english = (held.predicted == held.toxic).mean()
    assert english >= 0.9
