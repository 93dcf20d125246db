"""Line dedup with two Bloom filters: hashes seen once and seen twice.

1. Every task marks the keys of its documents in a pair of filters; pairs merge slice by slice,
   where a bit set on both sides counts as seen twice. A key in two documents is always in the
   second filter, so nothing that repeats is missed.
2. Only keys found in the second filter are shuffled, as whole keys, for the exact count of
   documents and the choice of the one document that keeps the line.
3. The rows that lose lines meet their keys by doc_id and a hash of the text, so that no list is longer
   than a text's own lines, however many rows share a doc_id or have none.

Defined cases: null or empty text is one empty line; keys shorter than MIN_CHARS code points never
count; several lines of one document with the same key count once and stay or go together; rows
that repeat a doc_id are one document to the counts, and each of them is returned; the rows without a
doc_id are together one document, smaller than all others; other columns of the input are not read.
The filters take BITS_FOR bits for each line that the texts' size lets expect, from LEAST_BITS to
MOST_BITS; beyond that more lines are suspected and shuffled, and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, checkpoint, fresh, merge_tree, pieces, tidily

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of each filter for a line, the bytes of text that a line takes, and the filter's bounds: 16 MB at most, broadcast.
BITS_FOR, LINE_BYTES, LEAST_BITS, MOST_BITS = 8, 100, 1 << 22, 1 << 27
SLICE_BITS = 1 << 19
SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short."""
    keys = [line.strip(SPACE).lower() for line in (text or b"").split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Four bit positions of each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(4, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def bits_for(docs: DataFrame) -> int:
    """A power of two for the size of the texts, which is read from their lengths alone."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_FOR * size // LINE_BYTES).bit_length()))


def seen_twice(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The second filter's bytes: keys marked by two documents at least."""
    width = min(SLICE_BITS, bits)

    def mark(it):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in pieces(it):
            hashes = [h for text in blobs(batch.column(0)) if len(h := _hashes({k for k in _keys(text, min_chars) if k is not None}))]
            if hashes:
                for h in np.split(np.concatenate(hashes), np.cumsum([len(h) for h in hashes])[:-1]):
                    p = _places(h, bits)
                    at, bit = p >> 3, (128 >> (p & 7)).astype(np.uint8)
                    known = (once[at] & bit).all(axis=1)
                    np.bitwise_or.at(twice, at[known], bit[known])
                    np.bitwise_or.at(once, at, bit)
        width_bytes = width // 8
        part = [k for k in range(bits // width) if once[k * width_bytes : (k + 1) * width_bytes].any()]
        if part:
            cut = lambda a: [a[k * width_bytes : (k + 1) * width_bytes].tobytes() for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cut(once)), pa.array(cut(twice))], ["slice", "once", "twice"])

    schema = "slice int, once binary, twice binary"
    marked = docs.select("text").mapInArrow(tidily(mark), schema)
    merged = merge_tree(marked, ["slice"], lambda t: _merge(t, width), schema, docs.rdd.getNumPartitions())
    rows = merged.select("slice", "twice").collect()  # bounded: the filter's size
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["twice"], np.uint8)
    return out


def _merge(table: pa.Table, width: int) -> pa.Table:
    """Filters of several tasks as one: a bit set on two sides has been seen twice."""
    once, twice = np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
    for o, t in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
        o = np.frombuffer(o, np.uint8)
        twice |= np.frombuffer(t, np.uint8) | (once & o)
        once |= o
    return pa.table({"slice": table["slice"][:1], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """(id, row, drop): for each doc_id and hash of a text that loses lines, their keys.

    Whether a key goes depends on its doc_id alone, so texts that agree in the hash may share a list.
    """
    bits = bits or bits_for(docs)
    sent = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, min_chars, bits))

    def suspects(it):
        twice = sent.value
        for batch in pieces(it):
            ids, rows, keys = [], [], []
            for i, row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), blobs(batch.column(1)), strict=True):
                own = list({k for k in _keys(text, min_chars) if k is not None})
                if own:
                    at = _places(_hashes(own), bits)
                    hit = (twice[at >> 3] << (at & 7) & 128).all(axis=1)
                    keys += (found := [k for k, h in zip(own, hit, strict=True) if h])
                    ids += [i] * len(found)
                    rows += [row] * len(found)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], ["id", "row", "key"])

    found = checkpoint(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidily(suspects), "id long, row long, key binary"))
    place = lambda c: F.struct(F.col(c).isNotNull(), F.col(c))  # noqa: E731  null is smaller than any id
    lines = found.select("id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max(place("id")).alias("keeper")).where(F.col("n") >= min_docs)
    lines = checkpoint(lines)  # so that the join shuffles both sides and a very common line can be split
    return found.join(lines, "key").where(place("id") < F.col("keeper")).groupBy("id", "row").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with text as kept, and the two named counts beside, or instead of, the other columns."""
    docs = docs.drop(*counts)
    own, row, gone_ = fresh("__id", docs), fresh("__row", docs), fresh("__drop", docs)
    drop = repeated_lines(docs.select(F.col("doc_id").cast("long"), "text"), min_chars, min_docs, bits).toDF(own, row, gone_)
    names = docs.columns
    joined = docs.join(drop, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(row)), "left").drop(own, row)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(it):
        for batch in pieces(it):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(blobs(batch.column("text")), batch.column(gone_).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if x.strip(SPACE).lower() not in gone]
                    kept.append(b"\n".join(stay))
                else:
                    stay = lines
                    kept.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, *counts])

    return joined.mapInArrow(tidily(cut), f"{schema}, {counts[0]} long, {counts[1]} long")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, coalesce(l.doc_id <> h.keeper, false) AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
