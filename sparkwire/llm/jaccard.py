"""Near copies by exact Jaccard similarity of word shingles, found by prefix filtering.

A text is the set of its 5-word shingles; a shorter text is one shingle. Two sets of similarity 0.8 or
more share a shingle among the first n - ceil(0.8 n) + 1 of each, in any one order of all shingles. So:

1. Every distinct set (a node) emits that prefix, once in a task; the shingles most frequent in a
   sample of texts come last in the order, which spares pairs and changes no result.
2. Nodes are candidates where the number of shared prefix shingles, their places and the sizes leave 0.8
   possible: sets of equal size share over 0.08 n of their prefixes. Each is compared with the least of
   its size in the group first, and so are nodes whose SimHash fingerprints meet in a ball (`meet`, that
   of simhash.links()). What that leaves in different components is compared pair by pair in
   groups of up to CROWD nodes; larger groups, crowds of near copies, meet in blocks of bounded size, and
   no pairs are formed. Pairs within a component would not change it.
3. The similarity of candidates is computed exactly and decides; links make components (single link).
   For that one text of each node is read again and goes compressed to the pairs.

So no pair is missed, whatever the size of the input. The work is more than linear only within a crowd that
the first comparison leaves in several components: a crowd's blocks meet each other. SimHash balls alone cannot give this: at similarity
0.8 fingerprints differ in about 10 of 64 bits, up to 19, and balls of that radius meet everywhere. So the
prefixes find what lies beyond the balls.

Defined cases: words are split at ASCII white space and lower-cased in ASCII; texts without words,
null ones included, are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOGETHER, blobs, checkpoint, pieces, slices, small, tidily, tokens_of
from .decontam import shingles_of, simhash
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: One text of so many is sampled for frequent shingles; those in so many sampled texts, and so many of them, come last.
SAMPLED, FREQUENT, LAST = 8, 3, 1 << 17
#: Groups of more nodes form no pairs, but meet in blocks of so many shingles.
CROWD, BLOCK = 64, 1 << 18
#: Nodes that a task remembers, to emit each once.
SEEN = 1 << 18
_LITTLE = 1e-9


def sets_of(texts: list[bytes], shingle: int = SHINGLE, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, those in `last` (sorted) at the end, and where each text's begin."""
    words, owner = tokens_of(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    full = np.flatnonzero(owner[: len(owner) - shingle + 1] == owner[shingle - 1 :]) if len(owner) >= shingle else np.zeros(0, np.int64)
    s, o = [shingles_of(words, shingle)[full]], [owner[full]]
    for k in range(1, shingle):
        short = np.flatnonzero(sizes == k)
        if len(short):
            s.append(shingles_of(words, k)[begins[short]])
            o.append(short.astype(np.int32))
    s, o = np.concatenate(s), np.concatenate(o)
    late = np.zeros(len(s), bool)
    if last is not None and len(last):
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    order = np.lexsort((s, late, o))
    s, o = s[order], o[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1]))) if len(s) else np.zeros(0, bool)
    s, o = s[first], o[first]
    return s, np.concatenate(([0], np.cumsum(np.bincount(o, minlength=len(texts))))).astype(np.int32)


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(np.sort(shingles).tobytes())).view(np.int64)) if len(shingles) else 0


def _shingled(docs: DataFrame, shingle: int, last: np.ndarray | None, similarity: float | None) -> DataFrame:
    """id, row, node, n, shingles, fp: for each row of docs (id, row, text) the prefix, or with no similarity the whole set.

    A prefix and the set's fingerprint come with the first of a task's rows of one node; the others have an
    empty list and none.
    """

    def run(it):
        seen: set[int] = set()
        for batch in pieces(it):
            texts = [t or b"" for t in blobs(batch.column(2))]
            for a, b in slices(texts):
                s, at = sets_of(texts[a:b], shingle, last)
                n = np.diff(at)
                nodes = np.fromiter((node_of(s[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, b - a)
                size, prints = n, [None] * len(n)
                if similarity is not None:
                    size = np.where(n > 0, n - np.ceil(similarity * n - _LITTLE).astype(np.int32) + 1, 0)
                    for k, node in enumerate(nodes.tolist()):
                        if node in seen:
                            size[k] = 0
                            continue
                        prints[k] = int(np.uint64(simhash(s[at[k] : at[k + 1]])).view(np.int64))
                        if len(seen) < SEEN:
                            seen.add(node)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                s = s[np.repeat(at[:-1] - ends[:-1], size) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(nodes), pa.array(n.astype(np.int32)), lists, pa.array(prints, pa.int64())], ["id", "row", "node", "n", "shingles", "fp"])

    return docs.mapInArrow(tidily(run), "id long, row long, node long, n int, shingles array<long>, fp long")


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    sample = docs.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0)
    counts = _shingled(sample, shingle, None, None).select(F.explode("shingles").alias("s")).groupBy("s").count()
    found = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(LAST).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _packed(rows: DataFrame) -> DataFrame:
    """node, z: texts of rows (node, text), compressed."""

    def run(it):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t or b"") for t in blobs(batch.column(1))], pa.binary())], ["node", "z"])

    return rows.select("node", "text").mapInArrow(tidily(run), "node long, z binary")


def _texts(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node, z: one text of each of the distinct nodes, read again."""
    needed = checkpoint(nodes.join(rows.select("node", "row"), "node").groupBy("node").agg(F.min("row").alias("row")))
    # rows that are equal throughout share a key, and one text of a node is enough
    return _packed(docs.join(small(needed), "row")).groupBy("node").agg(F.min("z").alias("z"))


def _commons(s: np.ndarray, at: np.ndarray):
    """A function of a range of sets, for how many of their elements each of all sets has: a matrix.

    Elements that a sixteenth of the sets have go through a matrix product, others through the lists of sets that have them.
    """
    size = len(at) - 1
    owner = np.repeat(np.arange(size), np.diff(at))
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[order][1:] != s[order][:-1]))) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    of = np.empty(len(s), np.int64)
    of[order] = np.repeat(np.arange(len(first)), count)
    often = np.flatnonzero((count > 1) & (count * 16 > size))
    column = np.full(len(first), -1)
    column[often] = np.arange(len(often))
    has = np.zeros((size, len(often)), np.float32)
    some = column[of] >= 0
    has[owner[some], column[of[some]]] = 1
    listed = owner[order]  # the sets of each element, element by element

    def common(a: int, b: int) -> np.ndarray:
        b = min(b, size)
        out = np.rint(has[a:b] @ has.T).astype(np.int64)
        rare = np.arange(at[a], at[b])
        rare = rare[(count[of[rare]] > 1) & (column[of[rare]] < 0)]
        n = count[of[rare]]
        ends = np.cumsum(n)
        places = np.repeat(first[of[rare]] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return out + np.bincount(np.repeat(owner[rare] - a, n) * size + listed[places], minlength=(b - a) * size).reshape(b - a, size)

    return common


def _crowded(crowds: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) among the nodes of one shingle and like size, of groups (s, node, n, r) too large to form pairs.

    A group is dealt into blocks of BLOCK shingles; two blocks meet in one task, which counts common
    shingles of all their nodes at once and returns links that join components, fewer than it has nodes.
    """
    size = F.floor(F.log("n") / max(1e-3, -math.log(similarity))).cast("int")
    crowds = crowds.select("s", "node", "n", "r", size.alias("size"))
    # sets that are similar are of one size class or of neighbouring ones: each class meets itself and the next
    crowds = crowds.withColumn("k", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    total = F.sum("n").over(Window.partitionBy("s", "k"))
    crowds = crowds.withColumn("blocks", F.ceil(total / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    crowds = crowds.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowds = crowds.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    texts = _texts(crowds.select("node").distinct(), rows, docs)

    def links(table: pa.Table) -> pa.Table:
        unpack, k = zstandard.ZstdDecompressor(), table["k"][0].as_py()
        nodes, roots, inner = table["node"].to_pylist(), table["r"].to_pylist(), table["size"].to_numpy() == k
        s, at = sets_of([unpack.decompress(z.as_py()) for z in table["z"]], shingle)
        n, common, parent = np.diff(at), _commons(s, at), {r: r for r in roots}

        def find(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        out = []
        for a in range(0, len(nodes), 256):
            both = common(a, a + 256)
            alike = both >= similarity * (n[a : a + 256, None] + n - both) - 1e-6
            alike &= inner[a : a + 256, None] | inner
            for x, y in np.argwhere(alike).tolist():
                x += a
                if x < y and (p := find(roots[x])) != (q := find(roots[y])):
                    parent[p] = q
                    out.append((nodes[x], nodes[y]))
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("a", "b"))})

    return crowds.drop("own", "other", "blocks").join(texts, "node").groupBy("s", "k", "i", "j").applyInArrow(links, "a long, b long").distinct()


def _similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least as similar; only the texts of their nodes are read again."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - _LITTLE

    def judged(rows: list[tuple[int, int]], texts: dict[int, bytes], before: dict[int, np.ndarray]) -> tuple[list, dict]:
        """The similar ones of rows, and the set of the last b: rows come in order of b, it may serve those that follow."""
        s, at = sets_of(list(texts.values()), shingle)
        sets = before | dict(zip(texts, np.split(s, at[1:-1]), strict=True))
        return [(a, b) for a, b in rows if alike(sets[a], sets[b])], {rows[-1][1]: sets[rows[-1][1]]}

    def run(it):
        unpack, before = zstandard.ZstdDecompressor(), {}
        for batch in pieces(it):
            own, texts, size, out = [], {}, 0, []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                for node, z in ((a, x), (b, y)):
                    if node not in texts and node not in before:
                        texts[node] = unpack.decompress(z.as_py())
                        size += len(texts[node])
                own.append((a, b))
                if size > TOGETHER:
                    found, before = judged(own, texts, before)
                    out += found
                    own, texts, size = [], {}, 0
            if own:
                found, before = judged(own, texts, before)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    pairs = checkpoint(pairs)
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, docs)
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("x")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("z").alias("y")), "b")
    return checkpoint(with_both.select("a", "b", "x", "y").mapInArrow(tidily(run), "a long, b long"))


def balls(rows: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): nodes of rows (node, fp or null) with the least of their fingerprint, and such least ones whose fingerprints meet."""
    nodes = rows.where("fp is not null").select("node", "fp").distinct()
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = meet(first.select("fp")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return same.union(near.select("x", "y"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, row, root: the component of each row of docs (id long, row long, text).

    meet(fps) gives links (a, b) among the distinct longs of column fp, SimHash fingerprints of the sets: the
    nodes that they join are compared first.
    """
    shingled = _shingled(docs, shingle, _frequent(docs, shingle), similarity)
    rows = checkpoint(shingled.select("id", "row", "node", "fp"))  # without the lists, which are made again
    met = shingled.select("node", "n", F.posexplode("shingles").alias("at", "s")).select("s", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    # one shuffle by shingle serves all three: copies fall together, lonely shingles go, the least is known
    met = met.repartition("s").dropDuplicates(["s", "node"])
    own = Window.partitionBy("s")
    # a hub serves sets of its own size; others are not similar to it, or are met in pairs
    alike = Window.partitionBy("s", F.floor(F.log("n") / max(1e-3, -math.log(similarity))))
    least = F.min(F.struct("n", "node", "rest", F.col("node").alias("r"))).over(alike)
    groups = checkpoint(met.withColumn("c", F.count("*").over(own)).withColumn("hub", least).where("c > 1").drop("c"))

    def candidates(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of rows (a, n, b, m, left), one for each shared shingle of the prefixes, that can be similar.

        `left` is how many shingles there are at most from the shared one on. Of two sets' common shingles,
        those up to the lesser end of the two prefixes are in both; what follows has not more than the rest.
        """
        beyond = F.greatest(*[F.ceil(similarity * F.col(c) - _LITTLE) - 1 for c in ("n", "m")])
        asked = similarity / (1 + similarity) * (F.col("n") + F.col("m")) - _LITTLE
        found = met.groupBy("a", "n", "b", "m").agg(F.count("*").alias("shared"), F.max("left").alias("left"))
        return found.where((F.col("left") >= asked) & (F.col("shared") + beyond >= asked)).select("a", "b")

    # stars only spare pairs: one that is not counted here in full is met again below
    stars = groups.where(F.col("node") != F.col("hub.node"))
    stars = stars.select(F.col("node").alias("a"), "n", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.least("rest", "hub.rest").alias("left"))
    first = candidates(stars)
    if meet is not None:
        first = first.union(balls(rows, meet)).distinct()
    links = _similar(first, rows, docs, shingle, similarity)
    roots = components(links).withColumnRenamed("root", "r")
    rooted = groups.select("s", "node", "n", "rest").join(roots, "node", "left").withColumn("r", F.coalesce("r", "node"))
    rooted = rooted.withColumn("several", F.min("r").over(own) != F.max("r").over(own)).withColumn("c", F.count("*").over(own))
    rooted = checkpoint(rooted.where("several").drop("several"))
    few = rooted.where(F.col("c") <= CROWD)
    x = few.select("s", F.col("node").alias("a"), "n", F.col("rest").alias("x_rest"), F.col("r").alias("x_r"))
    y = few.select("s", F.col("node").alias("b"), F.col("n").alias("m"), "rest", "r")
    sizes = (F.col("m") >= similarity * F.col("n") - _LITTLE) & (F.col("n") >= similarity * F.col("m") - _LITTLE)
    pairs = x.join(y, "s").where("a < b and x_r <> r").where(sizes).select("a", "n", "b", "m", F.least("x_rest", "rest").alias("left"))
    links = links.union(_similar(candidates(pairs), rows, docs, shingle, similarity))
    crowds = rooted.where(F.col("c") > CROWD)
    if not crowds.isEmpty():
        links = links.union(checkpoint(_crowded(crowds, rows, docs, shingle, similarity)))
    roots = components(links)
    return rows.join(roots, "node", "left").select("id", "row", F.coalesce("root", "node").alias("root"))
