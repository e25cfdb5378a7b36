"""WARC archives: one gzip member per record, read in sequence with incremental decompression.

The writer makes one archive per partition in the shared folder, under a name of its own, and names it in a manifest;
what a lost or repeated task has left behind is in no manifest. The reader takes archives from any store that pyarrow
opens, frames records by Content-Length, and checks block and payload digests while it reads, in bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import open_store, shared_dir, written

#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
RECORD = "path string, offset long, record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, block_bytes long, verified boolean, payload binary"


def plan_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, payload) with record_type and refers_to.

    Among equal payloads of at least `least` bytes the largest page_id is the response, others revisit it; shorter
    payloads are all responses. A null page_id is never the largest; where all are null, all are responses. Rows that
    repeat the largest page_id are responses too. The grouping is by digest and pre-aggregates; the join back
    is a plain one, whose hot keys adaptive execution splits.
    """
    hashed = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = hashed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = hashed.join(groups, "payload_digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, F.col("largest")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with the HTTP header alone."""
    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = header + payload if refers_to is None else header
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


#: What stays as it is in a header line; control characters, spaces and others are percent-encoded.
SAFE = "!#$%&'()*+,/:;=?@[]~-._|"


def write_warc(planned: DataFrame, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes an archive per partition of plan_revisits' rows; returns the manifest (path, records, bytes), itself a written table. An empty partition writes none."""
    folder = shared_dir(planned.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            columns = [batch.column(x) for x in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    store, at = open_store(path)
                    store.create_dir(at.rpartition("/")[0])
                    out = store.open_output_stream(at)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(c.compress(record_bytes(*(x[i].as_py() for x in columns), date)) + c.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    columns = planned.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return written(columns.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class Members:
    """The decompressed bytes of a stream of gzip members (or of plain bytes), read piece by piece."""

    def __init__(self, raw) -> None:
        self.raw, self.rest, self.ready, self.taken, self.z = raw, b"", b"", 0, None
        self.plain = None

    def _more(self) -> bool:
        while True:
            if not (data := self.rest):
                data = self.raw.read(CHUNK)
                self.taken += len(data)
            self.rest = b""
            if not data:
                if self.z is not None and not self.z.eof and self.plain is False:
                    raise EOFError("the archive ends inside a gzip member")
                return False
            if self.plain is None:
                self.plain = data[:2] != b"\x1f\x8b"
            if self.plain:
                self.ready += data
                return True
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, CHUNK)
            if self.z.eof:
                self.rest = self.z.unused_data
                self.z = None
            else:
                self.rest = self.z.unconsumed_tail
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream. A line of over MOST_HEADER bytes is malformed, and no more than that and a piece is held."""
        seen = 0
        while (k := self.ready.find(b"\n", seen)) < 0:
            if (seen := len(self.ready)) > MOST_HEADER:
                raise ValueError("a line has no end")
            if not self._more():
                if self.ready:
                    raise EOFError("the archive ends inside a line")
                return None
        out, self.ready = self.ready[:k], self.ready[k + 1 :]
        return out.rstrip(b"\r")

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise EOFError("the archive ends inside a block")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def place(self) -> int:
        """Compressed bytes that were consumed."""
        return self.taken - len(self.rest)


#: Bytes of a record's header, and of the HTTP header in its block, beyond which an archive is malformed, or a block has no header.
MOST_HEADER = 1 << 20


def _headers(m: Members) -> dict[str, str]:
    found: dict[str, str] = {}
    size = 0
    while (text := m.line()) not in (b"", None):
        size += len(text)
        if size > MOST_HEADER:
            raise ValueError("a record's header has no end")
        name, _, value = text.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def agrees(said: str, digest: bytes) -> bool:
    """Whether a digest that a header states (sha1, in hex or base32) is this one; other algorithms, and none, cannot disagree."""
    name, _, value = said.strip().partition(":")
    if name.lower() != "sha1" or not value:
        return True
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def as_hex(said: str) -> str:
    """A stated digest in bare lower-case hex."""
    value = said.strip().partition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def read_records(raw, path: str, with_payload: bool) -> Iterator[dict]:
    """The records of one archive in order. A malformed or truncated archive raises; a digest that differs gives verified = false.

    The length that an HTTP header states is compared too, but for bodies that are encoded for transfer. A revisit has no
    payload of its own: its digest is what its header states.
    """
    m = Members(raw)
    while True:
        offset = m.place() if not m.ready else -1
        first = m.line()
        if first is None:
            return
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{path}: no WARC record at {offset}")
        head = _headers(m)
        size = int(head["content-length"])
        block, payload, http, kept, length, seen = hashlib.sha1(), hashlib.sha1(), b"", [], 0, 0
        in_body = not head.get("content-type", "").startswith("application/http")
        for piece in m.pieces(size):
            block.update(piece)
            if not in_body:
                http += piece
                if (k := http.find(b"\r\n\r\n")) < 0:
                    if len(http) <= MOST_HEADER:
                        continue
                    http, piece, in_body = b"", http, True
                else:
                    http, piece, in_body = http[:k], http[k + 4 :], True
            payload.update(piece)
            seen += len(piece)
            if with_payload:
                kept.append(piece)
        declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        kind = head.get("warc-type")
        length = int(declared[1]) if kind == "revisit" and declared else seen
        said_block, said_payload = head.get("warc-block-digest", ""), head.get("warc-payload-digest", "")
        encoded = re.search(rb"(?im)^(transfer|content)-encoding:", http)
        good = agrees(said_block, block.digest()) and (kind == "revisit" or (agrees(said_payload, payload.digest()) and (not declared or bool(encoded) or int(declared[1]) == seen)))
        yield {
            "path": path, "offset": offset, "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to_id": head.get("warc-refers-to"),
            "payload_bytes": length, "payload_digest": as_hex(said_payload) if kind == "revisit" else payload.hexdigest(), "block_bytes": size, "verified": good, "payload": b"".join(kept) if with_payload and kind != "revisit" else None,
        }


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all archives that the manifest's column path names, an archive to a task. An empty manifest gives no record. payload is null for revisits, or for all without with_payload."""
    spark = manifest.sparkSession
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_bytes", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = open_store(path)
                rows, size = [], 0
                with store.open_input_stream(at) as raw:
                    for r in read_records(raw, path, with_payload):
                        rows.append(r)
                        size += 300 + len(r["payload"] or b"")
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not n:
        return spark.createDataFrame([], RECORD)
    return manifest.select("path").repartition(n).mapInArrow(read, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    records = read_warc(write_warc(plan_revisits(pages)), with_payload=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"), "verified")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to, true AS verified
FROM g
"""
