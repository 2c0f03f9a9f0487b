"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick automaton
over characters finds, in one pass, the longest token that starts at every byte. The
encoder walks these longest matches. A token may follow another only if merging their
concatenation would give exactly these two tokens; that test undoes the merges on both
sides of the seam, and its answers are memoised. Where no continuation fits, the encoder
steps back and takes a shorter token; a position that failed once is never tried again,
so the time is linear in the piece.

Null texts count as empty (no tokens). Every text is encoded whole.
"""

import base64
import gc
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the memo of pieces and of the memo of adjacent tokens, in each worker.
PIECES, SEAMS = 400_000, 1_000_000


# Up to U+024F, the letters, the decimal digits, and what a plain text must not
# hold (other numbers, and white space on whose class the two regex libraries disagree).
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9"
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


def plain_pattern(pattern: str) -> str:
    """The same pattern for plain texts, with Unicode classes written out as ranges."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", LETTERS).replace(r"\p{N}", DIGITS), pattern)
    return inside.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{DIGITS}]")


class Memo(dict):
    """A dict that computes what is missing and starts anew when it is full."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self._find = regex.compile(pattern).findall
        self._find_plain = re.compile(plain_pattern(pattern)).findall
        self.matches = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.matches.add_word(b.decode("latin-1"), i)
        self.matches.make_automaton()
        self.shorter = {i: self._prefix(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.fits = Memo(self._fits, SEAMS)
        for i in sorted(self.bytes_of):
            self._split(i)
        self.fits.clear()  # answers given while the merges were incomplete
        self.pieces = Memo(self._piece, PIECES)
        self.text_of = {i: str(i) for i in self.bytes_of}

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), -1)

    def _split(self, token: int) -> None:
        """Find the last merge that makes a token: two older tokens that fit together."""
        whole = self.bytes_of[token]
        left = self.shorter[token]
        while left >= 0:
            right = self.ids.get(whole[self.length[left] :], token)
            if left < token and right < token and self._fits((left, right)):
                self.parts[token], self.merges[left, right] = (left, right), token
                return
            left = self.shorter[left]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the joint bytes of two tokens leaves the seam between them."""
        left, right = pair
        oldest = 1 << 60  # a merge across the seam counts only if it is older than this one
        while True:
            if self.merges.get((left, right), oldest) < oldest:
                return False
            # undo the younger of the two merges that lie at the seam
            for take_left in (left > right, left <= right):
                if take_left and left in self.parts:
                    oldest, left = left, self.parts[left][1]
                    break
                if not take_left and right in self.parts:
                    oldest, right = right + 1, self.parts[right][0]
                    break
            else:
                return True

    def find_pieces(self, text: str) -> list[str]:
        """The pieces that are encoded separately; plain texts take the faster of two equal patterns."""
        return self._find(text) if NOT_PLAIN(text) else self._find_plain(text)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ids.get(data)
        return (whole,) if whole is not None else tuple(self.encode_bytes(data))

    def encode_bytes(self, data: bytes) -> list[int]:
        longest = [-1] * (len(data) + 1)
        for end, token in self.matches.iter(data.decode("latin-1")):
            longest[end + 1 - self.length[token]] = token  # ends come in order, so the longest stays
        out: list[int] = []
        dead = bytearray(len(data) + 1)
        at, token, n = 0, longest[0], len(data)
        length, shorter, fits = self.length, self.shorter, self.fits
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or fits[out[-1], token]):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        return [i for p in self.find_pieces(text) for i in pieces[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (base64 token and rank on each line), built once in a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoder = Encoder(ranks, pattern)
    gc.freeze()  # the tables live as long as the worker
    return encoder


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids are decoded again."""

    def run(batches):
        enc = load(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = enc.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(" ".join([enc.text_of[i] for i in ids]).encode()).hexdigest())
                text_sha.append(sha(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every row."""

    def run(batches):
        enc = load(path, pattern)
        for batch in batches:
            ids = [enc.encode(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text that the ids stand for (bytes that are no UTF-8 become U+FFFD)."""

    def run(batches):
        enc = load(path, pattern)
        for batch in batches:
            texts = [enc.decode(ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
