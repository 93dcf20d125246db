"""The prefix trie of conversations, built level by level.

1. Turns get their places in a conversation by ranges of the order, not by one window for each conversation,
   so that a very long conversation is not one task; conversations are rebuilt from them.
2. Level by level, live conversations are grouped by (parent node, next turn); the least conv_id of a
   group names the node. A conversation that is alone in its node has a chain below it, which needs no
   more levels. A subtree of at most `small_rows` rows is finished, level by level too, in the task that
   its node falls to; larger ones go on as Spark joins.
3. Levels are joined in reverse: counts of children, leaves and savings go up to the parents.

Turns are compared by the SHA-256 of role and text with the role's length before them. The ids of the
conversations that end in a node are hashed as they stream by in order: one hash is one sequence, so the
ids of one node are one task's, a batch at a time.
Defined cases: rows without a conv_id take no part; null role or text is empty; turns of one number come
in the order of their digests, null numbers first; repeated rows are turns of their own; conv_id % 100 has
the sign of conv_id; a conversation whose rebuilt form has no turn ends in the root; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small, tidily

#: A subtree of so many turns and conversations, or of a SHARE of all turns if that is more, up to MOST_ROWS, is finished in one task.
SMALL_ROWS, SHARE, MOST_ROWS = 4096, 1024, 1 << 20
#: Rows of finished subtrees that one task takes.
TOGETHER = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
PREFIX, GROUP = 6, 100
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): places from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = turns.where(F.col("conv_id").isNotNull()).withColumn("tie", F.monotonically_increasing_id())
    order = ["turn", "digest", "tie"]
    dealt = checkpoint(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").count()
    counts = counts.select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return dealt.withColumn("place", place).join(counts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) of the rebuilt conversations, and (conv_id, total): their lengths."""
    turns = checkpoint(turns)
    lengths = checkpoint(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIX
    ids = lengths.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = lengths.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    ids = ids.join(small(bases), "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    ids = checkpoint(ids.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < PREFIX)).withColumnRenamed("conv_id", "base")
    lent = ids.join(small(first), "base").where(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "digest", "chars")
    own = turns.join(small(ids), "conv_id").where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "digest", "chars")
    return checkpoint(lent.union(own)), ids.select("conv_id", "total")


def _finish(table: pa.Table) -> pa.Table:
    """Nodes of whole subtrees; a subtree's top, known by rows without a digest, gets what lies below it only."""
    node, at, turns, made = {}, {}, {}, {}
    rows = zip(*(table[c].to_pylist() for c in ("node", "conv_id", "depth", "digest", "chars")), strict=True)
    for top, conv, depth, digest, chars in rows:
        if digest is None:
            node[conv], at[conv] = top, depth
            made.setdefault((depth, top), {"parent": None, "n": 0, "chars": 0, "children": 0, "leaves": 0, "saved": 0, "ends": []})["n"] += 1
        else:
            turns.setdefault(depth, []).append((conv, digest, chars))
    tops = set(made)
    for depth in sorted(turns):
        groups: dict[tuple, list] = {}
        for conv, digest, chars in turns[depth]:
            groups.setdefault((node[conv], digest, chars), []).append(conv)
        for (parent, _, chars), convs in groups.items():
            first = min(convs)
            made[depth, first] = {"parent": parent, "n": len(convs), "chars": chars, "children": 0, "leaves": 0, "saved": 0, "ends": []}
            for conv in convs:
                node[conv], at[conv] = first, depth
    for conv in sorted(at):
        made[at[conv], node[conv]]["ends"].append(conv)
    for (depth, _), x in sorted(made.items(), key=lambda item: -item[0][0]):
        x["leaves"] = x["leaves"] or 1
        if x["parent"] is not None:
            x["saved"] += (x["n"] - 1) * x["chars"]
            up = made[depth - 1, x["parent"]]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + x["leaves"], up["saved"] + x["saved"]
    column = lambda of, kind: pa.array([of(k, x) for k, x in made.items()], kind)
    long = pa.int64()
    return pa.table({
        "depth": column(lambda k, x: k[0], long), "conv_id": column(lambda k, x: k[1], long), "parent_conv_id": column(lambda k, x: x["parent"], long),
        "n_convs": column(lambda k, x: x["n"], long), "n_children": column(lambda k, x: x["children"], long), "n_leaves": column(lambda k, x: x["leaves"], long),
        "saved_tokens": column(lambda k, x: x["saved"], long), "ends_sha256": column(lambda k, x: hashlib.sha256(",".join(map(str, x["ends"])).encode()).hexdigest(), pa.string()),
        "top": column(lambda k, x: k in tops, pa.bool_()),
    })


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, node, conv_id): one running hash for each node."""

    def run(it):
        key, digest = None, None
        for batch in it:
            done = []
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, node), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield from _rows(done)
        if key:
            yield from _rows([(*key, digest.hexdigest())])

    def _rows(done):
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["depth", "conv_id", "ends_sha256"])

    dealt = ended.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id")
    return dealt.select("depth", "node", "conv_id").mapInArrow(run, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, small_rows: int | None = None) -> DataFrame:
    """One row for each node, as the module's docstring says."""
    turns, lengths = rebuilt(numbered_turns(conversations))
    every = turns.count()
    small_rows = small_rows or max(SMALL_ROWS, min(MOST_ROWS, every // SHARE))
    root = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    live = lengths.select("conv_id", root.alias("node"), F.col("total").alias("left"))
    size = [F.count("*").alias("n_convs"), F.sum(F.col("left") + 1).alias("size")]
    nodes = live.groupBy("node").agg(*size).select(F.lit(None).cast("long").alias("parent"), "node", F.lit(0).cast("long").alias("chars"), "n_convs", "size")
    kind = F.when(F.col("n_convs") == 1, "alone").when(F.col("size") <= small_rows, "small").otherwise("large")
    levels, rests, ended, rows = [], [], [], turns
    depth = 0
    while True:
        nodes = checkpoint(nodes.withColumn("kind", kind))
        levels.append(nodes)
        live = checkpoint(live.join(small(nodes.select("node", "kind")), "node"))
        rests.append(live.where(F.col("kind") != "large").withColumn("depth", F.lit(depth).cast("long")))
        there = nodes.where(F.col("kind") == "large").agg(F.count("*"), F.coalesce(F.sum(F.col("size") - F.col("n_convs")), F.lit(0))).first()
        if not there[0]:
            break
        large = live.where(F.col("kind") == "large")
        ended.append(large.where(F.col("left") == 0).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        large = large.where(F.col("left") > 0).select("conv_id", F.col("node").alias("parent"), (F.col("left") - 1).alias("left"))
        depth += 1
        if 2 * there[1] < every:  # rows that are done with are not read at every level
            rows, every = checkpoint(rows.where(F.col("depth") >= depth).join(small(large.select("conv_id")), "conv_id", "left_semi")), there[1]
        grown = checkpoint(rows.where(F.col("depth") == depth).join(small(large), "conv_id"))
        nodes = checkpoint(grown.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.max("chars").alias("chars"), *size))
        live = grown.join(small(nodes.select("parent", "digest", "node")), ["parent", "digest"]).select("conv_id", "node", "left")
        nodes = nodes.drop("digest")

    rest = checkpoint(_all(rests))
    alone, shared = rest.where(F.col("kind") == "alone"), rest.where(F.col("kind") == "small")
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    end = lambda last: F.when(last, own).otherwise(EMPTY)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    below = turns.join(small(alone.select("conv_id", F.col("depth").alias("top"), (F.col("depth") + F.col("left")).alias("total"))), "conv_id").where(F.col("depth") > F.col("top"))
    last = F.col("depth") == F.col("total")
    chains = below.select("depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), end(last).alias("ends_sha256"))
    tops = alone.select("depth", "conv_id", (F.col("left") > 0).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), end(F.col("left") == 0).alias("ends_sha256"))

    marks = shared.select("node", "conv_id", "depth", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("chars"))
    within = turns.join(small(shared.select("conv_id", "node", F.col("depth").alias("top"))), "conv_id").where(F.col("depth") > F.col("top"))
    buckets = max(2 * conversations.sparkSession.sparkContext.defaultParallelism, every // TOGETHER)
    dealt = marks.union(within.select("node", "conv_id", "depth", "digest", "chars")).withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    finished = checkpoint(dealt.groupBy("bucket").applyInArrow(_finish, f"{NODE}, top boolean"))
    names = [f.split()[0] for f in NODE.split(", ")]
    out = [chains.select(*names), finished.where(~F.col("top")).select(*names)]
    tops = checkpoint(tops.union(finished.where("top").select(*tops.columns)))
    ends = checkpoint(_ends(_all(ended))) if ended else None

    done = None  # the level below
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level].withColumnRenamed("node", "conv_id")
        here = nodes.where(F.col("kind") != "large").join(small(tops.where(F.col("depth") == level).drop("depth")), "conv_id")
        if done is not None:
            up = done.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            up = nodes.where(F.col("kind") == "large").join(small(up), "conv_id", "left").join(small(ends.where(F.col("depth") == level).drop("depth")), "conv_id", "left")
            up = up.withColumns({"n_children": F.coalesce("n_children", none), "n_leaves": F.coalesce("n_leaves", one), "saved_tokens": F.coalesce("saved_tokens", none), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))})
            here = here.unionByName(up)
        saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")
        done = checkpoint(here.select(F.lit(level).cast("long").alias("depth"), "conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends_sha256"))
        out.append(done)
    return _all(out)


def _all(frames: list[DataFrame]) -> DataFrame:
    first, *more = frames
    for df in more:
        first = first.unionByName(df)
    return first


SQL = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x // 2, 3988292384 * (x % 2)) + i))) % 6 AS h FROM own),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 100),
member AS (SELECT conv_id AS c, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
at_ AS (
  SELECT c, depth, len(turns) AS n_turns, length(turns[depth]['text']) AS chars,
         min(c) OVER (PARTITION BY depth, turns[1:depth]) AS node FROM member),
nodes AS (
  SELECT depth, node, count(*) AS n, coalesce(max(chars), 0) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM at_ GROUP BY depth, node),
linked AS (SELECT n.*, a.node AS parent FROM nodes n LEFT JOIN at_ a ON a.c = n.node AND a.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT a.depth, a.node, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM linked x LEFT JOIN kids k ON k.depth = x.depth AND k.node = x.node JOIN at_ a ON a.c = x.node AND a.depth <= x.depth GROUP BY ALL)
SELECT n.node AS conv_id, n.depth, n.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
       b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node JOIN below b ON b.depth = n.depth AND b.node = n.node
"""
