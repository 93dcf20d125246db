"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text; shingles are five
words. A benchmark item of L words is compared with windows of L words of a document (the whole
document if it is shorter):

1. A window that shares no shingle with an item has similarity zero, so windows are set up only where
   a document has a shingle of some item, aligned as in the item and up to SLACK words beside.
2. The window's SimHash over its shingles, repeats counted, is looked up among the fingerprints of
   items of L words by a multi-index: 64 bits in BLOCKS blocks; two fingerprints within RADIUS agree
   in some block within RADIUS // BLOCKS bits, and every item is entered under all such values, so
   that none within RADIUS is missed. RADIUS is three standard deviations above the distance to be
   expected at the least similarity.
3. The weighted Jaccard similarity of the two multisets of shingles is computed exactly and decides.

Items are broadcast in blocks of ITEMS rows and BYTES bytes at most; a larger benchmark takes one
pass over the documents for each block.

Defined cases: null or empty texts match nothing; items of fewer than five words take no part; rows
that repeat an item_id or a doc_id give one row for each pair of ids; remove_contaminated() judges each row
by its own text; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, hash_words, mix, pieces, slices, table, tidily

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, SLACK = 19, 8, 2
ITEMS, BYTES = 20_000, 32 << 20
FILTER_BITS = 22

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def lowered(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in blobs(pc.utf8_lower(column.cast(pa.string())))]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the place where each text's begin (one more at the end)."""
    hashes, starts = hash_words(b"\n".join(texts), _APART)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)


def shingles_of(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The hash of the n words from each place on; places near the end have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mix(out)


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def similarity(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


class Index:
    """Fingerprints of items of one length, by the values of their blocks."""

    def __init__(self, radius: int = RADIUS, blocks: int = BLOCKS):
        self.radius, self.blocks, self.width = radius, blocks, 64 // blocks
        self.flips = [sum(1 << b for b in c) for n in range(radius // blocks + 1) for c in combinations(range(self.width), n)]
        self.at: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.prints: list[int] = []

    def _values(self, fp: int):
        return ((b, fp >> b * self.width & (1 << self.width) - 1) for b in range(self.blocks))

    def add(self, fp: int) -> None:
        for b, v in self._values(fp):
            for f in self.flips:
                self.at[b, v ^ f].append(len(self.prints))
        self.prints.append(fp)

    def near(self, fp: int) -> list[tuple[int, int]]:
        """(place, distance) of every fingerprint within the radius."""
        found = {i for key in self._values(fp) for i in self.at.get(key, ())}
        return [(i, d) for i in found if (d := (self.prints[i] ^ fp).bit_count()) <= self.radius]


class Benchmark:
    def __init__(self, rows: list[tuple[int, bytes]]):
        """rows: item_id and lower-cased text."""
        self.items, self.bags, by_shingle = [], [], defaultdict(set)
        self.index: dict[int, tuple[Index, list[int]]] = {}
        for item, text in rows:
            words, _ = words_of([text])
            hashes = shingles_of(words)
            if not len(hashes):
                continue
            k = len(self.items)
            self.items.append((item, len(words)))
            self.bags.append(Counter(hashes.tolist()))
            for j, h in enumerate(hashes.tolist()):
                by_shingle[h].add((len(words), j))
            index, own = self.index.setdefault(len(words), (Index(), []))
            index.add(simhash(hashes))
            own.append(k)
        self.known = np.array(sorted(by_shingle), np.uint64)
        self.aligned = [sorted(by_shingle[int(h)]) for h in self.known]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are shingles of items, and which."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(at):
            return at, at
        which = np.searchsorted(self.known, hashes[at])
        ok = self.known[np.minimum(which, len(self.known) - 1)] == hashes[at]
        return at[ok], which[ok]

    def matches(self, hashes: np.ndarray, anchors, least: float = SIMILARITY) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance): the best window for each item that reaches the least similarity."""
        n_words = len(hashes) + SHINGLE - 1
        windows = set()
        for i, k in zip(*anchors, strict=True):
            for length, j in self.aligned[k]:
                last = max(0, n_words - length)
                windows.update((min(max(0, i - j + d), last), length) for d in range(-SLACK, SLACK + 1))
        best: dict[int, tuple] = {}
        for start, length in sorted(windows):
            own = hashes[start : start + length - SHINGLE + 1]
            index, items = self.index[length]
            near, bag = index.near(simhash(own)), None
            for place, distance in near:
                bag = bag or Counter(own.tolist())
                k = items[place]
                s = similarity(bag, self.bags[k])
                if s >= least and s > best.get(self.items[k][0], (0, 0, 0, 0))[3]:
                    best[self.items[k][0]] = (self.items[k][0], start, min(length, n_words), s, distance)
        return list(best.values())


    def search(self, texts: list[bytes], least: float = SIMILARITY):
        """(place, matches) of every text that has any."""
        for a, b in slices(texts):
            words, at = words_of(texts[a:b])
            hashes = shingles_of(words)
            places, which = self.anchors(hashes)
            where = np.searchsorted(at, places, side="right") - 1
            inside = places + SHINGLE <= at[where + 1]
            places, which, where = places[inside], which[inside], where[inside]
            for d in np.unique(where).tolist():
                mine = where == d
                found = self.matches(hashes[at[d] : at[d + 1] - SHINGLE + 1], ((places[mine] - at[d]).tolist(), which[mine].tolist()), least)
                if found:
                    yield a + d, found


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of the benchmark of bounded size, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // BYTES))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        got = part.collect()  # bounded: a block
        texts = lowered(pa.array([r["text"] for r in got], pa.string()))
        yield sorted(zip([r["item_id"] for r in got], texts, strict=True))


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each document and item it contains: the best window, its similarity and fingerprint distance."""
    context = docs.sparkSession.sparkContext

    def scan(rows):
        sent = context.broadcast(rows)

        def run(it):
            own = Benchmark(sent.value)
            for batch in pieces(it):
                ids = batch.column(0).to_pylist()
                out = [(ids[row], *x) for row, found in own.search(lowered(batch.column(1)), least) for x in found]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidily(run), SCHEMA)

    found = reduce(DataFrame.union, [scan(rows) for rows in benchmark_blocks(benchmark)])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("first_word")).alias("w"), "n_words")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.w")).alias("first_word"), "x.n_words", "x.similarity", (-F.col("x.d")).cast("int").alias("distance"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows whose own text has no passage of the benchmark; they are dropped where they are read, without a join."""
    context, schema = docs.sparkSession.sparkContext, docs.schema

    def without(docs: DataFrame, rows) -> DataFrame:
        sent = context.broadcast(rows)

        def run(it):
            own = Benchmark(sent.value)
            for batch in pieces(it):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in own.search(lowered(batch.column("text")), least)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(tidily(run), schema)

    return reduce(without, benchmark_blocks(benchmark), docs)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
