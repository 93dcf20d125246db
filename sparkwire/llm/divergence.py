"""Source divergence audit: which terms set a source apart from its language, and sources from each other.

1. Every task adds its documents to a count-min sketch of document frequencies of (lang, term), whose
   cells stop at the threshold; sketches merge slice by slice. A cell never tells less than the
   frequency (up to the threshold), so a term whose cells are lower cannot be kept and is not shuffled.
2. The terms that may be kept are counted exactly, by (lang, source, term), summed in the task first;
   those in fewer than min_docs documents of a language go.
3. The sums over all kept terms come from sparse rows: terms that two sources share are joined term by
   term (sorted by term, neighbours at each distance), and a term that a source lacks has one
   probability for the whole source, so it enters by a histogram of counts.

Integers throughout: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).
Defined cases: null text, lang and source are empty strings; terms are runs of ASCII letters and
characters beyond ASCII, of which only A-Z are lower-cased; every row is a document of its own, whether
its id repeats or not; a language without kept terms gives pairs of value 0; a language with one source
gives no pair; a term's rows are read as they come, however long the text; other columns are not read.
The sketch has ROWS rows of one cell for CELL_BYTES bytes of text, LEAST_CELLS to MOST_CELLS (96 MB,
broadcast). It lets a term pass wrongly if all its cells are full; beyond some 30 million kept terms it
lets most pass, and the result is the same.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs, checkpoint, merge_tree, pieces, small, tidily

MIN_DOCS, TOP = 10, 10
SCALE = 10**9
ROWS, CELL_BYTES, LEAST_CELLS, MOST_CELLS = 3, 128, 1 << 16, 1 << 25
SLICE = 1 << 16
#: Distinct terms that a task holds before it hands them on, and group pairs that it sums.
HELD = 1 << 19
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """UTF-8's bytes beyond ASCII belong to characters beyond ASCII, so bytes do as well as characters."""
    return TERM.findall(text.lower()) if text else []


def cells_for(docs: DataFrame) -> int:
    """A power of two for the size of the texts, which is read from their lengths alone."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))


def _hashes(lang: str, terms) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64)


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes + np.uint64(row) * step) % np.uint64(cells)).astype(np.int64)


def add(sketch: np.ndarray, hashes: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Adds counts to the sketch's rows; cells stop at most."""
    for row in range(len(sketch)):
        sums = np.bincount(_cells(hashes, row, sketch.shape[1]), np.minimum(counts, most), sketch.shape[1])
        sketch[row] = np.minimum(sketch[row] + sums, most)


def possible(sketch: np.ndarray, hashes: np.ndarray, most: int) -> np.ndarray:
    """Whether each term may reach most."""
    out = np.ones(len(hashes), bool)
    for row in range(len(sketch)):
        out &= sketch[row][_cells(hashes, row, sketch.shape[1])] >= most
    return out


def sketch_of(docs: DataFrame, min_docs: int, cells: int) -> np.ndarray:
    """The merged sketch of document frequencies; docs has lang and text without nulls."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")
    width = min(SLICE, cells)

    def build(it):
        sketch = np.zeros((ROWS, cells), np.uint8)
        held: dict[str, Counter] = {}

        def hand_on():
            for lang, terms in held.items():
                add(sketch, _hashes(lang, terms), np.fromiter(terms.values(), np.int64), min_docs)
            held.clear()

        for batch in pieces(it):
            for lang, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD:
                hand_on()
        hand_on()
        flat, pack = sketch.reshape(-1, width), zstandard.ZstdCompressor(1).compress
        part = np.flatnonzero(flat.any(axis=1))
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack(flat[k].tobytes()) for k in part], pa.binary())], ["slice", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint16)
        for packed in table["cells"].to_pylist():
            total = np.minimum(total + np.frombuffer(zstandard.decompress(packed), np.uint8), min_docs).astype(np.uint16)
        return pa.table({"slice": table["slice"][:1], "cells": [zstandard.compress(total.astype(np.uint8).tobytes(), 1)]})

    schema = "slice int, cells binary"
    built = docs.select("lang", "text").mapInArrow(tidily(build), schema)
    out = np.zeros((ROWS * cells // width, width), np.uint8)
    for r in merge_tree(built, ["slice"], merge, schema, docs.rdd.getNumPartitions()).collect():  # bounded: the sketch's size
        out[r["slice"]] = np.frombuffer(zstandard.decompress(r["cells"]), np.uint8)
    return out.reshape(ROWS, cells)


def counted(docs: DataFrame, min_docs: int, cells: int) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term that the sketch lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch_of(docs, min_docs, cells))

    def count(it):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on():
            for (lang, source), (n, df) in held.items():
                stay = np.flatnonzero(possible(sent.value, _hashes(lang, n), min_docs))
                if len(stay):
                    terms, every = list(n), np.fromiter(n.values(), np.int64)
                    terms = [terms[i] for i in stay]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(stay)), pa.array([source] * len(stay)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(every[stay]), pa.array([df[t] for t in terms], pa.int64())],
                        ["lang", "source", "term", "n", "df"],
                    )
            held.clear()

        for batch in pieces(it):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found := terms_of(text))
                df.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from hand_on()
        yield from hand_on()

    rows = docs.mapInArrow(tidily(count), "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int | None = None) -> DataFrame:
    """(lang, source, term, n, n_lang, lead): exact counts of kept terms; lead marks one row of each (lang, term)."""
    term = Window.partitionBy("lang", "term")
    every = counted(docs, min_docs, cells or cells_for(docs)).withColumn("in_docs", F.sum("df").over(term))
    every = every.withColumn("n_lang", F.sum("n").over(term)).withColumn("lead", F.min("source").over(term) == F.col("source"))
    return checkpoint(every.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "lead"))


def _p(count: str, total: str, v: str) -> Column:
    """Exact: the product may pass 64 bits, so it is a decimal's."""
    return F.expr("1 + (cast({s} as decimal(10,0)) * cast({c} + 2 as decimal(20,0))) div cast({n} + 2 * {v} as decimal(20,0))".format(s=SCALE, c=count, n=total, v=v)).cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})").cast("long")


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value), source < item: what terms that two groups share add to the sums over single groups.

    rows: (lang, term, source, p, p0), one for each kept term of a group. A term's rows are neighbours of
    each other in the sorted partition; of pairs only sums by two groups leave the task.
    """

    def meet(it):
        codes: dict[tuple, int] = {}
        sums: Counter = Counter()
        carry = None

        def flush():
            names = list(codes)
            keys = list(sums)
            if keys:
                left, right = [names[k >> 32] for k in keys], [names[k & 0xFFFFFFFF] for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in left]), pa.array([g[1] for g in left]), pa.array([g[1] for g in right]), pa.array([sums[k] for k in keys], pa.int64())], ["lang", "source", "item", "value"])
            sums.clear()

        def pairs(table, new):
            groups = list(zip(table["lang"].to_pylist(), table["source"].to_pylist(), strict=True))
            code = np.fromiter((codes.setdefault(g, len(codes)) for g in groups), np.int64, len(groups))
            p, zero = table["p"].to_numpy(), table["p0"].to_numpy()
            of = np.cumsum(new)
            f = lambda a, b: (a - b) * (a - b) // (a + b)
            for d in range(1, len(of)):
                at = np.flatnonzero(of[d:] == of[:-d])
                if not len(at):
                    break
                x, y = at, at + d
                value = f(p[x], p[y]) - f(p[x], zero[y]) - f(zero[x], p[y]) + f(zero[x], zero[y])
                key, inverse = np.unique(code[x] << 32 | code[y], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, value)
                for k, v in zip(key.tolist(), total.tolist(), strict=True):
                    sums[k] += v
                if len(sums) > HELD:
                    yield from flush()

        for batch in it:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([carry, table]) if carry is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            lang, term = table["lang"].combine_chunks(), table["term"].combine_chunks()
            differs = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], differs))
            last = int(np.flatnonzero(new)[-1])  # the last term may go on in the next batch
            carry = table.slice(last)
            yield from pairs(table.slice(0, last), new[:last])
        if carry is not None:
            yield from pairs(carry, np.arange(carry.num_rows) == 0)
        yield from flush()

    dealt = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.select("lang", "source", "term", "p", "p0").mapInArrow(tidily(meet), "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: part pair for every other source of the language, part term for the top terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_terms(docs, min_docs, cells)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.sum(F.col("lead").cast("long")).alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("n_terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = docs.select("lang", "source").distinct().join(small(langs), "lang", "left").join(small(sizes), ["lang", "source"], "left")
    groups = groups.select("lang", "source", zero("n_all"), zero("v"), zero("n_group"), zero("n_terms"))
    groups = checkpoint(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "n_group", "v"))))
    rows = kept.join(small(groups), ["lang", "source"]).withColumn("p", _p("n", "n_group", "v"))

    terms = rows.withColumn("q", _p("n_lang", "n_all", "v")).where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("n_terms").alias("m_terms"))
    away = F.col("source") != F.col("item")
    none = groups.join(other, "lang").where(away)
    none = none.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("n_terms") - F.col("m_terms")) * _f("p0", "q0"), F.lit(0)).alias("value"))
    alone = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).join(small(other), "lang").where(away)
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _f("p", "q0")).alias("value"))
    swap = lambda df: df.union(df.select("lang", F.col("item"), F.col("source"), "value"))
    shared = checkpoint(shared_terms(rows).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = none.union(swap(alone)).union(swap(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, sum(n_lang) AS n_all, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n_group
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n_group + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 2)) // (l.n_all + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM full_ WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
"""
