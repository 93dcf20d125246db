"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less share a variant at distance 1 or less from both. Every
distinct fingerprint emits its ball of 65 variants; variants are shuffled, and those that two
fingerprints share give links. Distinct fingerprints around one variant number 65 at most and lie
within distance 2 of each other, so a star around the least of them loses no link's component.

Defined cases: null or empty text has fingerprint zero and links like any other; copies share one
fingerprint and never become pairs; a null doc_id is a row of its own, larger than all others, and
its component's id is null only where no other id is in the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard
from .common import blobs, checkpoint, fresh, pieces, small, tidily
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
_HASHES_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; without words zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[k : k + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and other columns of longs: the fingerprint as a signed long."""

    def run(it):
        for batch in pieces(it):
            fp = np.fromiter(map(fingerprint, blobs(batch.column(1))), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", *others])

    return docs.select(F.col("doc_id").cast("long"), "text", *others).mapInArrow(tidily(run), ", ".join(["doc_id long, fp long", *[f"{c} long" for c in others]]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for the distinct longs of column fp: each fingerprint of a ball with the ball's least."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    ball = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    # one shuffle and a sort that can spill; a window holds one ball's fingerprints, 65 at most
    pairs = ball.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where(F.col("fp") != F.col("low"))
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    fps = checkpoint(fingerprints(docs))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp")))
    linked = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(classes, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame):
    """A hash of the whole row; xxhash64 passes over nulls, so which columns are null goes in too."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*[c.isNull() for c in columns], *columns)


def least_rows(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows that are first in their component of found (doc_id, row, root); equal rows become one.

    `key` names the rows' hash, row in found. Only what goes, and rows that occur more than once, are looked
    up: lists that are broadcast if they are counted to be small, so that most texts are not shuffled.
    """
    found = checkpoint(found)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    counted = found.groupBy("row").agg(F.count("*").alias("n"))
    named = counted.join(first.select(F.col("least.row").alias("row"), F.lit(True).alias("first")), "row", "left").select(F.col("row").alias(key), "n", F.coalesce("first", F.lit(False)).alias("stays"))
    apart = checkpoint(named.where("n > 1 or not stays"))
    gone, repeated = small(apart.select(key)), apart.where("stays").select(key)
    out = rows.join(gone, key, "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(small(repeated), key, "left_semi").dropDuplicates([key]))
    return out.drop(key)


def keep_one(docs: DataFrame, similarity: float | None = None, shingle: int = jaccard.SHINGLE) -> DataFrame:
    """One row of each component: that of the least doc_id, null last, then of the least hash of the row.

    Components are those of near_duplicates(). With a similarity, rows whose fingerprints meet in a ball are
    candidates for an exact check, and jaccard.near_copies() adds those that no ball can reach.
    """
    key = fresh("__row", docs)
    rows = docs.withColumn(key, row_key(docs))
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("row"))
    if similarity is not None:
        found = jaccard.near_copies(slim.select(F.col("doc_id").alias("id"), "row", "text"), shingle, similarity, links).withColumnRenamed("id", "doc_id")
        return least_rows(rows, found, key).select([f"`{c}`" for c in docs.columns])
    fps = checkpoint(fingerprints(slim, ("row",)))
    roots = components(links(fps.select("fp").distinct()))
    found = fps.join(roots, fps.fp == roots.node, "left").select("doc_id", "row", F.coalesce("root", "fp").alias("root"))
    return least_rows(rows, found, key).select([f"`{c}`" for c in docs.columns])
