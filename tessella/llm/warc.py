"""Operator 10, WARC archives with a two-level capture index.

Writing: every task streams its pages into WARC files of its own (a gzip member a record) in the shared folder and
gives an index line for each record; a retried task writes new files, and only lines of the attempt that counts are
kept. Lines are ordered by reversed-host URL key over range partitions (the id is part of the order, so one hot URL
splits), packed into compressed blocks of BLOCK_LINES, and each block's first key goes to a sparse directory.

Reading: keys to look up are range-partitioned and sorted alike; a task binary-searches the directory, range-reads the
one block, finds the line in it by binary search, and range-reads the record. The directory has one row for BLOCK_LINES
records (raise it for very large crawls); blocks and open files are cached one and few at a time.

Equal payloads of at least LEAST bytes are stored once: the record with the largest page_id is the response, the others
are revisits with its id, its digest and the HTTP headers, which hold the length. The digest groups are aggregates with
a maximum; their join back to pages is a broadcast below BROADCAST_ROWS groups and salted beyond.

Defined cases: null html is an empty payload, a response. A null url is filed under an empty key. Null page_ids are
looked up as such; one is a response only if its group has no other id. Repeated rows have records of their own; of a
group's rows with the largest id all are responses. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, slices, table, trim

LEAST = 1_000
BLOCK_LINES = 3_000
FILE_BYTES = 1 << 30
#: Records that a task reads back, about.
READS = 8_000
SALTS, BROADCAST_ROWS = 16, 100_000
_SAFE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed and lower-cased, then what follows the host; ASCII, without blanks."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        scheme, rest = "", scheme
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    return quote(",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :], safe=_SAFE)


def entry_key(url: str | None, page_id: int | None) -> str:
    """The order of the index: URL key, then id."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = quote(url or "about:blank", safe=_SAFE)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: {refers_to}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(member: bytes) -> dict:
    """Headers, HTTP headers and payload of a compressed record; a response's payload must agree with its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if headers["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
    return {"headers": headers, "payload": payload, "bytes": int(fields["Content-Length"]), "digest": digest}


@dataclass(frozen=True)
class Archive:
    """Where the WARC files, the compressed index blocks and the directory lie."""

    path: str
    records: int = 0

    @property
    def directory(self) -> str:
        return f"{self.path}/directory"


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id and entry key of each page, without its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 10_000):
            keys = [entry_key(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(keys, pa.string())], names=["page_id", "key"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "page_id long, key string")


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    many = cut(rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").select("digest", "keep"), "payloads")
    if many.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(many), "digest", "left")
    else:
        salted = many.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return both.select("page_id", "url", "payload", "digest", "size", F.when(revisit, F.col("keep")).alias("refers_to"))


def write_archive(pages: DataFrame, block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Writes pages (page_id, url, html) as WARC files, their index and its directory."""
    out = Archive(fresh(pages.sparkSession, "warc"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out.path)
        fs.create_dir(f"{base}/warc", recursive=True)
        sink, name, at = None, "", 0
        for b in slices(batches):
            keys, lines = [], []
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None or at > file_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{base}/warc/{name}", compression=None)
                revisit = refers_to is not None
                member = record(page_id, url, payload, digest, refers_to, revisit)
                sink.write(member)
                keys.append(entry_key(url, page_id))
                lines.append(json.dumps({"digest": digest, "type": "revisit" if revisit else "response", "length": len(member), "offset": at, "filename": name}))
                at += len(member)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])
        if sink is not None:
            sink.close()

    lines = cut(marked(pages).mapInArrow(archive, "key string, line string"), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out.path)
        fs.create_dir(f"{base}/index", recursive=True)
        name, sink, at, held, found = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush():
            nonlocal sink, at, held
            if sink is None:
                sink = fs.open_output_stream(f"{base}/index/{name}", compression=None)
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = deflate.compress("\n".join(f"{k} {x}" for k, x in held).encode()) + deflate.flush()
            sink.write(block)
            found.append((held[0][0], held[-1][0], name, at, len(block), len(held)))
            at, held = at + len(block), []

        for b in batches:
            for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(pair)
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array(c) for c in zip(*found)], names=["first", "last", "filename", "offset", "length", "lines"])

    records = lines.count()
    parts = max(8, math.ceil(records / 500_000))
    blocks = lines.repartitionByRange(parts, "key", F.xxhash64("line")).sortWithinPartitions("key", "line").mapInArrow(index, "first string, last string, filename string, offset long, length long, lines long")
    blocks.write.parquet(out.directory)
    return Archive(out.path, records)


class Reader:
    """Looks entries up: directory by binary search, then one range read for the block and one for the record."""

    def __init__(self, archive: Archive):
        self.fs, self.base = pafs.FileSystem.from_uri(archive.path)
        found = [f.path for f in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/directory")) if f.path.endswith(".parquet")]
        rows = sorted(r for p in found for r in zip(*(c.to_pylist() for c in pq.read_table(p, filesystem=self.fs).columns)))
        self.rows, self.last = rows, [r[1] for r in rows]
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.blocks: OrderedDict[int, tuple[list[str], list[str]]] = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            self.files[path] = self.fs.open_input_file(f"{self.base}/{path}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        return self.files[path].read_at(length, offset)

    def block(self, k: int) -> tuple[list[str], list[str]]:
        if k not in self.blocks:
            _, _, name, offset, length, _ = self.rows[k]
            lines = zlib.decompress(self.read(f"index/{name}", offset, length), 31).decode().split("\n")
            self.blocks[k] = [" ".join(x.split(" ", 2)[:2]) for x in lines], [x.split(" ", 2)[2] for x in lines]
            if len(self.blocks) > 4:
                self.blocks.popitem(last=False)
        return self.blocks[k]

    def lines(self, key: str) -> Iterator[str]:
        """Index lines with this entry key, in order."""
        k = bisect.bisect_left(self.last, key)
        while k < len(self.rows) and self.rows[k][0] <= key:
            keys, lines = self.block(k)
            at = bisect.bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                yield lines[at]
                at += 1
            k += 1

    def get(self, line: str) -> dict:
        x = json.loads(line)
        return parse(self.read(f"warc/{x['filename']}", x["offset"], x["length"]))


def read_back(archive: Archive, pages: DataFrame) -> DataFrame:
    """The records of pages (page_id, url), each found through the index and read from the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, rest = None, None, iter(())
        for b in slices(batches):
            reader = reader or Reader(archive)
            rows = []
            for page_id, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != key:  # repeated entries take the lines one after the other
                    key, rest = own, reader.lines(own)
                x = reader.get(next(rest))
                refers = x["headers"].get("X-Refers-To-Page-ID")
                rows.append((page_id, x["bytes"], x["digest"], x["headers"]["WARC-Type"], None if refers is None else int(refers)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        trim()

    # a stated number of partitions is not merged: keys are small, the records behind them are not
    parts = max(8, math.ceil(archive.records / READS))
    return _keyed(pages).repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, RESULT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_back(write_archive(pages), pages)


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= {LEAST} GROUP BY 1 HAVING count(*) > 1
)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN keep IS NOT NULL AND p.page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
