"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. The
vector of an n-gram binds its letters: each letter's vector is rotated by its place, and they
are multiplied. A document bundles (adds) the vectors of its n-grams; a language prototype
bundles the unit vectors of its training documents. A document gets the language whose
prototype has the largest cosine with it, after the mean of the prototypes, which all
languages share, has been taken off.

Texts are lower-cased; anything but letters is one word boundary. All of a text counts. The
fit may read a bounded sample: at most about `per_language` documents of each language,
chosen by a hash; the bound is a parameter.

Defined results: null texts and texts without a letter get `und` and score 0; so does every
text if nothing was learned. Ties go to the language first in order. Rows without lang teach
nothing. Repeated rows get the same answer.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions, letters in an n-gram, seed, training documents of a language, rows of the n-gram table.
DIMENSIONS, LETTERS, SEED, PER_LANGUAGE, NGRAM_ROWS = 512, 3, 7, 4000, 60_000
UNKNOWN = "und"


class Space:
    """Item memory of letters and a bounded table of bound n-gram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = LETTERS, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letter = lru_cache(maxsize=50_000)(self._letter)
        self.rows: dict[int, int] = {}
        self.table = np.empty((NGRAM_ROWS, dimensions), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        return np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1

    def bind(self, ngram: int) -> np.ndarray:
        """The product of the letters' vectors, each rotated by its distance from the last letter."""
        out = np.ones(self.dimensions, np.float32)
        for k in range(self.n):
            out *= np.roll(self.letter(ngram >> (21 * k) & 0x1FFFFF), k)
        return out

    def vectors(self, ngrams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(ngrams) > NGRAM_ROWS:
            self.rows.clear()
        rows, at = self.rows, []
        for g in ngrams.tolist():
            row = rows.get(g)
            if row is None:
                row = rows[g] = len(rows)
                self.table[row] = self.bind(g)
            at.append(row)
        return self.table[at]

    def bundle(self, text: str) -> np.ndarray | None:
        """The unit vector of a text, or None where it has no letter."""
        ngrams, counts = count_ngrams(text, self.n)
        if not len(ngrams):
            return None
        out = np.zeros(self.dimensions, np.float64)
        step = NGRAM_ROWS // 2
        for a in range(0, len(ngrams), step):
            out += counts[a : a + step].astype(np.float32) @ self.vectors(ngrams[a : a + step])
        size = np.linalg.norm(out)
        return out / size if size else None


def _plain() -> np.ndarray:
    """For every UTF-16 unit: the unit if it is a letter or part of a surrogate pair, else a space."""
    return np.array([c if chr(c).isalpha() or 0xD800 <= c < 0xE000 else 32 for c in range(0x10000)], np.uint32)


@lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    return _plain()


def count_ngrams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a letter) and their counts, within words padded by one boundary."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    plain = np.where(codes < 0x10000, letters_table()[np.minimum(codes, 0xFFFF)], codes)
    if (codes >= 0x10000).any():
        plain = np.array([c if chr(c).isalpha() else 32 for c in plain.tolist()], np.uint32)
    plain = plain[np.concatenate(([True], (plain[1:] != 32) | (plain[:-1] != 32)))]
    if len(plain) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = np.concatenate((np.full(max(0, n - len(plain)), 32, np.uint32), plain)).astype(np.int64)
    grams = np.zeros(len(wide) - n + 1, np.int64)
    for k in range(n):
        grams = grams << 21 | wide[k : len(wide) - n + 1 + k]
    return np.unique(grams, return_counts=True)


@lru_cache(maxsize=4)
def space(dimensions: int, n: int, seed: int) -> Space:
    return Space(dimensions, n, seed)


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, n: int = LETTERS, seed: int = SEED, per_language: int = PER_LANGUAGE):
    """(languages, prototypes) from the text and lang of `docs`; each task bundles its own rows first."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = known.groupBy("lang").count()
    # a share of each language, chosen by the text, so that about per_language documents are read closely;
    # one small row for each language is broadcast: the model itself holds as many vectors on the driver
    chosen = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) * F.col("count") < per_language * 1_000_000)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums = space(dimensions, n, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                v = s.bundle(text.as_py())
                if v is not None:
                    sums[lang] = sums.get(lang, 0.0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], ["lang", "k", "v"])

    parts = chosen.select("lang", "text").mapInArrow(bundles, "lang string, k int, v double")
    # summed as whole numbers: the order of the tasks then changes nothing
    cells = parts.groupBy("lang", "k").agg(F.sum(F.round(F.col("v") * 1e9).cast("decimal(30,0)")).cast("double").alias("v"))
    got = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("vector")).orderBy("lang").collect()
    languages = [r.lang for r in got]
    prototypes = np.array([[x.v for x in r.vector] for r in got]).reshape(len(got), dimensions)
    return languages, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model, dimensions: int = DIMENSIONS, n: int = LETTERS, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    languages, prototypes = model
    shared = prototypes.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
    own = prototypes - shared
    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12) if len(languages) else own

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space(dimensions, n, seed)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                v = s.bundle(text.as_py() or "") if languages else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = v - shared
                cosines = own @ v / max(np.linalg.norm(v), 1e-12)
                best = int(cosines.argmax())
                langs.append(languages[best])
                scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(answers, "doc_id long, lang_pred string, score double")


def accuracy(predicted: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Rows and right answers by language, for rows with a language."""
    both = predicted.join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).toPandas()
