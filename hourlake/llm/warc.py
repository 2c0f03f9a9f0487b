"""WARC archives with a two-level capture index.

Writing: each task writes one file of records, every record a gzip member of its own, below a
folder that all executors share, and returns a capture line (sorted-host key, date, and as
JSON the url, digest, kind, file, offset and length) for each record. A repeated attempt
writes another file; only files named in the stored capture lines are ever read, so a lost
executor leaves unused bytes and nothing else.

Index: the capture lines are range-partitioned and sorted by key, and cut into compressed
blocks of some thousand lines. The directory has one short entry for each block (its first
and last key, cut to `KEY_BYTES`). Blocks get longer when there are very many lines, so the
directory never has more than `ENTRIES` entries: that bound makes it fit to be broadcast.

Reading: the wanted keys are looked up by binary search in the directory, then in the lines
of the blocks found; each hit is read from its archive by offset and length, parsed and
checked against its digest.

Payloads: of records with equal payloads of at least `SMALLEST` bytes the one with the largest
page_id is a response, the others are revisits of it; smaller ones are all responses. The
revisits' HTTP headers tell the length of the full payload.

Defined results: a null html is an empty payload; a null url is an empty key; characters that
a header cannot hold are percent-encoded. Repeated rows with the same page_id are records of
their own, all responses or all revisits; a null page_id is smaller than any other.
"""

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.llm.common import folder, stored

SMALLEST, LEVEL, FILE_BYTES = 1000, 4, 1 << 30
LINES, ENTRIES, KEY_BYTES = 3000, 400_000, 160
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the format.
VERSION, ID = "WARC/1.1", "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The url with its host reversed (`com,example,www)/path?query`): pages of a site lie together."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = parts.hostname or "", parts.port
    except ValueError:  # no url; it is its own key
        return quote(text.lower(), safe="!*'();:@&=+$,/?#[]%")
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = parts.path or "/"
    query = f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else ""
    return quote(f"{host}{port}){path}{query}".lower(), safe="!*'();:@&=+$,/?[]%")


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def http_block(payload: bytes, with_payload: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (payload if with_payload else b"")


def record(page: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record, without compression."""
    block = http_block(payload, refers_to is None)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers (names in lower case), and the payload that the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no record begins here: {lines[0][:40]!r}")
    named = [dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in lines[1:]))]
    size = int(named[0]["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    named.append(dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])))
    return named[0], named[1], payload


def _kinds(pages: DataFrame, at: str) -> DataFrame:
    """page_id, url, payload and `winner`: the page that has the equal payload, where there is one with a larger id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    keyed = rows.where(F.octet_length("payload") >= SMALLEST).select("page_id", F.sha1("payload").alias("sha"))
    # stored, so that its size is known before the payloads are joined: few groups then cost no shuffle of payloads
    winners = stored(keyed.groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{at}/winners")
    sha = F.when(F.octet_length("payload") >= SMALLEST, F.sha1("payload"))
    return rows.withColumn("sha", sha).join(winners, "sha", "left").select("page_id", "url", "payload", "winner")


def write_archives(pages: DataFrame, at: str) -> DataFrame:
    """Writes all records below `at`; returns their capture lines (key, line) as a stored table."""

    def run(batches):
        store, root = store_of(at)
        store.create_dir(f"{root}/archives", recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            keys, lines = [], []
            for page, url, payload, winner in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "winner")), strict=True):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/archives/{name}", compression=None)
                shown = quote((url or "").strip(), safe="!*'();:@&=+$,/?#[]%~")
                refers = str(winner) if winner is not None and page != winner else None
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record("null" if page is None else str(page), shown, payload, refers)) + packer.flush()
                out.write(member)
                key = url_key(url)
                entry = {"url": shown, "kind": "response" if refers is None else "revisit", "file": name, "offset": offset, "length": len(member)}
                keys.append(key)
                lines.append(f"{key} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(entry, ensure_ascii=False)}")
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], ["key", "line"])
        if out is not None:
            out.close()

    return stored(_kinds(pages, at).mapInArrow(run, "key string, line string"), f"{at}/captures")


def build_index(captures: DataFrame, at: str, lines: int = LINES, entries: int = ENTRIES) -> DataFrame:
    """Blocks (block, n, first, last, data) of sorted capture lines, as a stored table below `at`."""
    size = max(lines, -(-captures.count() * 2 // entries))  # twice: a partition's last block may be short
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select(F.encode("key", "utf-8").alias("key"), F.encode("line", "utf-8").alias("line"))
    ordered = ordered.repartitionByRange(min(parts, entries // 2), "key", "line").sortWithinPartitions("key", "line")

    def run(batches):
        kept: list[tuple[bytes, bytes]] = []
        block = TaskContext.get().partitionId() << 32

        def packed(rows):
            nonlocal block
            block += 1
            data = zlib.compress(b"\n".join(line for _, line in rows), 6)
            return pa.RecordBatch.from_arrays(
                [pa.array([block - 1]), pa.array([len(rows)]), pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([data])],
                ["block", "n", "first", "last", "data"],
            )

        for batch in batches:
            kept += zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True)
            while len(kept) >= size:
                yield packed(kept[:size])
                kept = kept[size:]
        if kept:
            yield packed(kept)

    return stored(ordered.mapInArrow(run, "block long, n long, first binary, last binary, data binary"), f"{at}/blocks")


def directory(blocks: DataFrame, entries: int = ENTRIES) -> tuple[list[bytes], list[bytes], list[int]]:
    """First and last keys (cut) and numbers of the blocks, in order; at most `entries` of them."""
    cut = [F.substring(F.col(c), 1, KEY_BYTES).alias(c) for c in ("first", "last")]
    rows = blocks.select("block", *cut).orderBy("block").limit(entries + 1).collect()
    if len(rows) > entries:
        raise ValueError("the directory is too large: build the index with longer blocks")
    return [bytes(r["first"]) for r in rows], [bytes(r["last"]) for r in rows], [r.block for r in rows]


def search(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """The capture lines of all captures whose key is among `keys` (key)."""
    spark = blocks.sparkSession
    known = spark.sparkContext.broadcast(directory(blocks))
    wanted = keys.where("key IS NOT NULL").select(F.encode("key", "utf-8").alias("key")).distinct()

    def find_blocks(batches):
        first, last, numbers = known.value
        for batch in batches:
            wanted_in: dict[int, list[bytes]] = {}
            for key in batch.column("key").to_pylist():
                short = key[:KEY_BYTES]
                for i in range(bisect.bisect_left(last, short), bisect.bisect_right(first, short)):
                    wanted_in.setdefault(numbers[i], []).append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(wanted_in), pa.int64()), pa.array([b"\n".join(v) for v in wanted_in.values()], pa.binary())], ["block", "wanted"]
            )

    def find_lines(batches):
        for batch in batches:
            found = []
            for data, wanted_keys in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                lines = zlib.decompress(data).split(b"\n")
                heads = [x[: x.index(b" ")] for x in lines]
                for key in wanted_keys.split(b"\n"):
                    found += lines[bisect.bisect_left(heads, key) : bisect.bisect_right(heads, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8") for x in found], pa.string())], ["line"])

    near = wanted.repartitionByRange("key").mapInArrow(find_blocks, "block long, wanted binary")
    return near.join(blocks.select("block", "data"), "block").select("data", "wanted").mapInArrow(find_lines, "line string")


def read_records(lines: DataFrame, at: str) -> DataFrame:
    """The records that capture lines point to, by range reads: ids, url, kind, full length, digest and payload (null for revisits)."""

    def run(batches):
        store, root = store_of(at)
        for batch in batches:
            entries = [json.loads(x.split(" ", 2)[2]) for x in batch.column("line").to_pylist()]
            rows, name, opened = [], None, None
            for e in sorted(entries, key=lambda e: (e["file"], e["offset"])):
                if e["file"] != name:
                    if opened is not None:
                        opened.close()
                    name, opened = e["file"], store.open_input_file(f"{root}/archives/{e['file']}")
                head, http, payload = parse(zlib.decompress(opened.read_at(e["length"], e["offset"]), 31))
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                size, kind = int(http["content-length"]), head["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{name} at {e['offset']}: the payload is not what its digest says")
                page, refers = (int(x) if x.isdigit() or x[1:].isdigit() else None for x in (head[k].strip("<>").removeprefix(ID) if k in head else "" for k in ("warc-record-id", "warc-refers-to")))
                rows.append((page, head["warc-target-uri"], size, digest, kind, refers, payload.decode("utf-8") if kind == "response" else None))
            if opened is not None:
                opened.close()
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return lines.mapInArrow(run, schema)


def keys_of(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["key"])

    return pages.select(F.col("url").cast("string")).mapInArrow(run, "key string")


def archive(spark: SparkSession, pages: DataFrame, at: str | None = None) -> tuple[str, DataFrame]:
    """Write archives and index of `pages` (page_id, url, html); the folder and the index blocks."""
    at = at or folder(spark, "warc")
    return at, build_index(write_archives(pages, at), at)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page's record, found through the index and read back from the archives."""
    at, blocks = archive(pages.sparkSession, pages)
    return read_records(search(blocks, keys_of(pages)), at)
