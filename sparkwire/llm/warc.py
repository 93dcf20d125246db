"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some records, and at its end the seek
table of the public seekable format in a skippable frame: sizes of every frame and a footer. The
index maps a record's identifier to its bundle, frame, offset within the decompressed frame and
length, so that one record is read by decompressing one frame.

Bundles are rows of a table (binary column) that Spark writes, so that they go to any store the
cluster has and survive lost executors; export() writes them as .warc.zst files where a folder can
be reached by path.

Defined cases: null html is an empty payload; null url is written as an empty target; a null page_id
has a record of its own; rows that repeat a page_id with one payload are all the response where that
page_id is the largest; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, checkpoint

LEAST_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
DATE = "2000-01-01T00:00:00Z"
#: Of the public seekable Zstandard format: magic of its skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NO_ID = "urn:uuid:ffffffff-ffff-4fff-bfff-ffffffffffff"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None) -> str:
    """A URN that holds the identifier in its last 16 digits."""
    if page_id is None:
        return _NO_ID
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"urn:uuid:57415243-0000-0000-{h[:4]}-{h[4:]}"


def page_of(urn: str | None) -> int | None:
    if not urn or urn == _NO_ID:
        return None
    v = int(urn.replace("-", "")[-16:], 16)
    return v - (1 << 64) if v >> 63 else v


def _field(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC 1.1 record: a response with its HTTP block, or a revisit without payload if refers_to is given."""
    head = [f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(url)}"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    block = _HTTP % len(payload)
    if refers_to is None:
        head.append("WARC-Type: response")
        block += payload
    else:
        head += ["WARC-Type: revisit", f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; close() gives the bytes and the index rows."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.limit, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.open, self.opened, self.index, self.bytes = [], [], [], 0, [], 0

    def add(self, key, data: bytes) -> None:
        if self.opened and self.opened + len(data) > self.limit:
            self._end()
        self.index.append((key, len(self.frames), self.opened, len(data)))
        self.open.append(data)
        self.opened += len(data)

    def _end(self) -> None:
        raw = b"".join(self.open)
        self.frames.append(self.zstd.compress(raw))
        self.sizes.append((len(self.frames[-1]), len(raw)))
        self.bytes += len(self.frames[-1])
        self.open, self.opened = [], 0

    def close(self) -> tuple[bytes, list]:
        if self.opened:
            self._end()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end")
    out, at = [], 0
    for size, raw in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, size, raw))
        at += size
    return out


def frame(bundle: bytes, n: int) -> bytes:
    at, size, raw = seek_table(bundle)[n]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=raw)


def fetch(bundle: bytes, n: int, offset: int, length: int) -> bytes:
    """One record by its place in the index."""
    return frame(bundle, n)[offset : offset + length]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record in data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(head["Content-Length"])
        yield head, data[end + 4 : at]
        at += 4


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The HTTP body and the length its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    return body, int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, sha1, refers_to: of equal payloads the largest page_id is the response.

    Equal payloads meet as (digest, page_id) only, aggregated before the shuffle; a digest with many
    copies is then split like any skewed join. The html goes through no shuffle but this join's.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes"))
    keys = pages.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    # a payload that is too small meets nothing: it goes by a key of its row, and empty ones heap up nowhere
    own = F.when(F.col("bytes") >= least, F.col("sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = pages.withColumn("key", own).join(keys.select(F.col("sha1").alias("key"), "largest"), "key", "left")
    refers = F.when((F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def write_bundles(rows: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of the rows of marked(): data, and index as arrays of (id, frame, offset, length)."""
    schema = "data binary, index array<struct<id: string, frame: int, offset: int, length: int>>"
    kind = pa.list_(pa.struct([("id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))

    def out(bundle: Bundle) -> pa.RecordBatch:
        data, index = bundle.close()
        return pa.RecordBatch.from_arrays([pa.array([data]), pa.array([[dict(zip(("id", "frame", "offset", "length"), x, strict=True)) for x in index]], kind)], ["data", "index"])

    def run(it):
        bundle = Bundle(frame_bytes)
        for batch in it:
            ids, urls, html, sha1, refers = (batch.column(k) for k in range(5))
            for page, url, payload, digest, to in zip(ids.to_pylist(), urls.to_pylist(), blobs(html), sha1.to_pylist(), refers.to_pylist(), strict=True):
                bundle.add(record_id(page), record(page, url, payload or b"", digest, to))
                if bundle.bytes >= bundle_bytes:
                    yield out(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield out(bundle)

    return rows.mapInArrow(run, schema)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of every bundle: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(it):
        for batch in it:
            for data in batch.column(0):
                data = data.as_py()
                for n in range(len(seek_table(data))):
                    rows = []
                    for head, block in parse(frame(data, n)):
                        body, stated = payload_of(block)
                        digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                        if (kind := head["WARC-Type"]) == "response" and (len(body) != stated or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        rows.append((page_of(head["WARC-Record-ID"][1:-1]), head["WARC-Target-URI"], stated, digest, kind, page_of(head.get("WARC-Refers-To", "")[1:-1]), body if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)

    return bundles.select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def index_of(bundles: DataFrame) -> DataFrame:
    """record id, frame, offset, length, and the SHA-1 of the bundle that has it."""
    return bundles.select(F.sha1("data").alias("bundle"), F.inline("index"))


def export(bundles: DataFrame, folder: str) -> None:
    """Writes bundles as files named by their digest; written beside and renamed, so that a repeated task does no harm."""

    def run(it):
        for batch in it:
            for data in batch.column(0).to_pylist():
                name = os.path.join(folder, hashlib.sha1(data).hexdigest() + ".warc.zst")
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    bundles.select("data").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The pages as bundles, written to the shared folder."""
    return checkpoint(write_bundles(marked(pages.select("page_id", "url", "html"), least)))


def digest(pages: DataFrame) -> DataFrame:
    return read_bundles(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""
