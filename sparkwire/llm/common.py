"""Shared helpers: table access, lineage cuts, word hashing over byte buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwire.session import checkpoint, shared_folder, spread  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are taken together, and bytes hashed at a time: few enough to stay in a core's cache.
TOGETHER, PIECE = 1 << 20, 1 << 16

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: A side of a join that is counted to have so many rows of a number or two is broadcast (about 32 MB).
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it is counted to be small; otherwise the join shuffles. df is checkpointed or cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, *frames: DataFrame) -> str:
    """The name with as many underscores before it as no column of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Tasks whose sums one task merges.
FAN = 64


def merge_tree(parts: DataFrame, keys: list[str], merge: Callable[[pa.Table], pa.Table], schema: str, tasks: int) -> DataFrame:
    """Merges rows of equal keys from many tasks in levels, so that no task reads more than FAN tasks' rows of a key.

    merge(table) makes one row of the rows of one key; schema is its schema and that of parts.
    """

    def one(table: pa.Table) -> pa.Table:
        return merge(table).append_column("part", table["part"][:1])

    out = parts.withColumn("part", F.spark_partition_id())
    while True:
        tasks = -(-tasks // FAN)
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*keys, "part").applyInArrow(one, f"{schema}, part int")
        if tasks <= 1:
            return out.drop("part")


def tidily(run: Callable) -> Callable:
    """run(batches), after whose last batch a worker, which lives on, gives back what memory it no longer uses."""

    @wraps(run)
    def tidy(it):
        yield from run(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return tidy


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts at a time are Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch  # before the next one comes


def ascii_lower(col):
    """A-Z only, as bytes.lower() does; Spark's lower() folds all of Unicode."""
    return F.translate(col, UPPER, LOWER)


def blobs(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(texts: list[bytes], limit: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def argsort(x: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit words: sorted as words that end in their place, which is several times faster.

    Places push out the lowest bits. Should different words agree in what is left, an ordinary sort follows.
    """
    bits = np.uint64(max(1, len(x) - 1).bit_length())
    packed = np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    y = x[order]
    if ((y[1:] != y[:-1]) & (y[1:] >> bits == y[:-1] >> bits)).any():
        return np.argsort(x, kind="stable")
    return order


def unique_inverse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit words in order, and the place of each element among them."""
    order = argsort(x)
    y = x[order]
    first = np.concatenate(([True], y[1:] != y[:-1])) if len(y) else np.zeros(0, bool)
    inverse = np.empty(len(x), np.int32)
    inverse[order] = np.cumsum(first, dtype=np.int32) - 1
    return y[first], inverse


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, PIECE + 1)
        up, down = _odd_powers(_BASE, m), _odd_powers(pow(_BASE, -1, 1 << 64), m)
        if m > 64 * PIECE:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def hash_words(text: bytes, space: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the runs of bytes outside `space`, in order.

    The hash is a polynomial over the bytes modulo 2^64, taken from one running sum, so no Python
    code runs for a single word. Texts are cut at spaces into pieces of about PIECE bytes.
    """
    buf = np.frombuffer(text, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf):  # move the cut to a space
            gap = np.flatnonzero(space[buf[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(buf), end + 4096)
        part = buf[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~space[part]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _pow(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts joined by a line break, and the index of each word's text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes, starts = hash_words(b"\n".join(texts).lower())
    return hashes, np.searchsorted(np.cumsum(lengths + 1), starts, side="right").astype(np.int32)
