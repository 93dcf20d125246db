"""Near-duplicate titles: an exact similarity join and the greedy collapse over it.

Rows are taken in order of (collected_at, seq). A row is dropped if a row kept before it has a title
whose word sets have a Jaccard similarity of 0.7 or more and is not over five days older; a missing
time counts as near. It is attached to the first such row.
"""

from __future__ import annotations

from bisect import bisect_left
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.functions.scores import parse_iso
from sparkwire.functions.text import text, title_tokens
from sparkwire.session import checkpoint

from .graph import components

THRESHOLD = (7, 10)
WINDOW_DAYS = 5


def _prepared(df: DataFrame, title: str, ident: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.sort_array(title_tokens(F.col(title))).alias("tok"), parse_iso(F.col("collected_at")).alias("ts"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold=THRESHOLD) -> DataFrame:
    """(a, b, common, united) of all pairs of (id, tok) with common / united >= threshold; within left, a < b.

    Distinct word sets are joined, not rows: copies of a title are one set. Sets meet on a word of
    their prefixes in order of rarity; a set of n words can only match if it shares one of its
    n - ceil(t n) + 1 rarest, so that frequent words make no candidates. The result has class pairs;
    members come back by the sets.
    """
    p, q = threshold
    own = left.withColumn("side", F.lit(0)) if right is None else left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    own = own.where(F.size("tok") > 0)
    sets = own.groupBy("side", "tok").agg(F.count("*").alias("n")).withColumn("set", F.xxhash64("tok"))
    words = sets.select("side", "set", "tok", F.explode("tok").alias("w"))
    frequency = sets.select(F.explode("tok").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(frequency, "w").groupBy("side", "set", "tok").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
    size = F.size("o")
    keep = size - F.ceil(size * p / F.lit(q)).cast("int") + 1
    prefix = ranked.select("side", "set", "tok", size.alias("size"), F.explode(F.slice("o", F.lit(1), keep)).alias("x")).select("side", "set", "tok", "size", F.col("x.w").alias("w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    sides = (F.col("a.side") == 0) & (F.col("b.side") == (0 if right is None else 1))
    near = (F.col("a.size") * q >= F.col("b.size") * p) & (F.col("b.size") * q >= F.col("a.size") * p)
    order = (F.col("a.set") < F.col("b.set")) if right is None else F.lit(True)
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & sides & near & order).select(F.col("a.tok").alias("ta"), F.col("b.tok").alias("tb")).distinct()
    common, united = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return pairs.select("ta", "tb", common.alias("common"), united.alias("united")).where(F.col("common") * q >= F.col("united") * p)


def links(df: DataFrame, title: str = "title", ident: str = "seq", threshold=THRESHOLD) -> DataFrame:
    """(ident, class_id, n_links): each row's class of equal word sets, by its least ident, and its similar other rows.

    Pairs are made between classes only; a class of n copies has n - 1 links each from within.
    """
    own = df.select(F.col(ident), F.sort_array(title_tokens(F.col(title))).alias("tok"))
    classes = own.where(F.size("tok") > 0).groupBy("tok").agg(F.min(ident).alias("class_id"), F.count("*").alias("n"))
    pairs = similar_pairs(own.withColumnRenamed(ident, "id"), threshold=threshold)
    both = pairs.select("ta", "tb").union(pairs.select("tb", "ta"))
    more = both.join(classes.select(F.col("tok").alias("tb"), "n"), "tb").groupBy(F.col("ta").alias("tok")).agg(F.sum("n").alias("more"))
    known = classes.join(more, "tok", "left").select("tok", "class_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = own.join(known, "tok", "left")
    return out.select(ident, F.coalesce("class_id", F.col(ident)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _edges(firsts: DataFrame, days: int, threshold=THRESHOLD) -> DataFrame:
    """(a, b) of (id, tok, ts): similar, a before b and near in time."""
    pairs = similar_pairs(firsts, threshold=threshold).select("ta", "tb")
    same = firsts.select(F.col("tok").alias("ta"), F.col("tok").alias("tb")).distinct()
    every = pairs.union(pairs.select("tb", "ta")).union(same)
    left, right = firsts.select(F.col("id").alias("a"), F.col("tok").alias("ta"), F.col("ts").alias("ts_a")), firsts.select(F.col("id").alias("b"), F.col("tok").alias("tb"), F.col("ts").alias("ts_b"))
    return every.join(left, "ta").join(right, "tb").where("a < b").where(_in_window("ts_a", "ts_b", days)).select("a", "b")


def _in_window(older: str, newer: str, days: int) -> Column:
    return F.coalesce(F.col(older) >= F.col(newer) - F.make_dt_interval(F.lit(days)), F.lit(True))


def leaders(df: DataFrame, title: str = "title", order: str = "seq", days: int = WINDOW_DAYS, decided: Column | None = None, most_links: int = 1 << 20) -> DataFrame:
    """(pos, leader): leader is null for kept rows, else the pos of the row it is attached to.

    Kept rows are the lexicographically first maximal independent set. Rows of one word set and one
    time share all neighbours, so that only the first of them is a node; the others follow it. Word sets
    with similar ones, directly or by others, are a component, and each component is settled in one pass
    over its nodes in order (_greedy): postings of one title, however many, make no pairs of postings.
    A component of more than most_links pairs of word sets goes by layers of edges instead (_layers).
    decided marks rows that are kept beforehand. pos must be unique; rows are compared by it.
    """
    own = _prepared(df.withColumn("__pos", F.col(order)), title, "__pos")
    if decided is None:
        own = own.withColumn("kept", F.lit(False))
    else:
        own = own.join(df.select(F.col(order).alias("id"), decided.alias("kept")), "id")
    nodes = own.where((F.size("tok") > 0) & ~F.col("kept")).groupBy("tok", "ts", "kept").agg(F.min("id").alias("id")).select("id", "tok", "ts", "kept")
    nodes = nodes.union(own.where((F.size("tok") > 0) & F.col("kept")).select("id", "tok", "ts", "kept"))
    word_set = lambda tok: F.sha2(F.array_join(tok, " "), 256)
    nodes = checkpoint(nodes.withColumn("cls", word_set("tok")))
    pairs = similar_pairs(nodes).select(word_set("ta").alias("cls"), word_set("tb").alias("other"))
    pairs = checkpoint(pairs.union(pairs.select("other", "cls")))
    roots = components(pairs.toDF("a", "b")).withColumnRenamed("node", "cls")
    placed = nodes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    near = pairs.join(roots, "cls")
    large = checkpoint(near.groupBy("root").count().where(F.col("count") > 2 * most_links).select("root"))
    lead = _greedy(placed.join(large, "root", "left_anti"), near.join(large, "root", "left_anti"), days)
    if large.limit(1).count():
        lead = lead.union(_layers(checkpoint(placed.join(large, "root", "left_semi").select("id", "tok", "ts", "kept")), days, decided is not None))
    lead = checkpoint(lead)
    first = nodes.where("not kept").join(lead, nodes["id"] == lead["pos"]).select(F.col("id").alias("first"), F.col("tok").alias("t"), F.col("ts").alias("at"), "leader")
    mates = own.join(first, (F.col("tok") == F.col("t")) & F.col("ts").eqNullSafe(F.col("at")) & ~F.col("kept"), "left")
    return mates.select(F.col("id").alias("pos"), F.coalesce("leader", F.when(F.col("first") != F.col("id"), F.col("first"))).alias("leader"))


def _greedy(nodes: DataFrame, near: DataFrame, days: int) -> DataFrame:
    """(pos, leader) of nodes (root, cls, id, ts, kept), by one pass over each component in order.

    Of the kept rows of a word set only those with a later time than all before can be the first one in a
    window, so that what is remembered grows with the kept rows' times, not with the postings.
    """
    kind = dict(nodes.dtypes)["id"]
    width = days * 86_400_000_000

    def run(it):
        root, other, kept, n = None, {}, {}, 0
        for batch in it:
            out, lead = [], []
            columns = [batch.column(c).to_pylist() for c in ("root", "cls", "other", "id", "us", "kept")]
            for r, cls, o, pos, us, is_kept in zip(*columns, strict=True):
                if r != root:
                    root, other, kept = r, {}, {}
                if o is not None:
                    other.setdefault(cls, []).append(o)
                    continue
                n += 1
                best = None
                if not is_kept:
                    oldest = -inf if us is None else us - width
                    for c in (cls, *other.get(cls, ())):
                        if c in kept:
                            times, at = kept[c]
                            i = bisect_left(times, oldest)
                            if i < len(times) and (best is None or at[i] < best):
                                best = at[i]
                    out.append(pos)
                    lead.append(best and best[1])
                if best is None:
                    times, at = kept.setdefault(cls, ([], []))
                    time = inf if us is None else us
                    if not times or time > times[-1]:
                        times.append(time)
                        at.append(_At((n, pos)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, types[0]), pa.array(lead, types[0])], ["pos", "leader"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(nodes.schema["id"].dataType)]
    null = F.lit(None)
    rows = nodes.select("root", "cls", null.cast("string").alias("other"), "id", F.unix_micros("ts").alias("us"), "kept", F.lit(1).alias("kind"))
    links = near.select("root", "cls", "other", null.cast(kind).alias("id"), null.cast("long").alias("us"), null.cast("boolean").alias("kept"), F.lit(0).alias("kind"))
    dealt = rows.union(links).repartition("root").sortWithinPartitions("root", "kind", "id")
    return dealt.mapInArrow(run, f"pos {kind}, leader {kind}")


class _At(tuple):
    """(number, pos), compared by the number: pos may be a struct."""

    def __lt__(self, other):
        return self[0] < other[0]


def _layers(nodes: DataFrame, days: int, decided: bool) -> DataFrame:
    """(pos, leader) of nodes (id, tok, ts, kept) by rounds over edges.

    A round settles every node that has a kept neighbour before it, or none that is undecided.
    """
    found = _edges(nodes, days)
    if decided:  # what is kept beforehand needs no edges
        found = found.join(nodes.where("not kept").select(F.col("id").alias("b")), "b", "left_semi")
    found = checkpoint(found)
    later = found.select(F.col("b").alias("id")).distinct().withColumn("u", F.lit(True))
    state = checkpoint(nodes.join(later, "id", "left").select(F.col("id").alias("pos"), F.when(F.col("kept") | F.col("u").isNull(), "K").otherwise("U").alias("s")))
    while state.where("s = 'U'").limit(1).count():
        before = found.join(state.select(F.col("pos").alias("a"), F.col("s").alias("sa")), "a")
        seen = before.groupBy("b").agg(F.max(F.col("sa") == "K").alias("k"), F.max(F.col("sa") == "U").alias("u"))
        settled = F.when(F.col("s") != "U", F.col("s")).when(F.coalesce("k", F.lit(False)), "D").when(~F.coalesce("u", F.lit(False)), "K").otherwise("U")
        state = checkpoint(state.join(seen, state.pos == seen.b, "left").select("pos", settled.alias("s")))
    kept = state.where("s = 'K'").select(F.col("pos").alias("a"))
    lead = found.join(kept, "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    return nodes.where("not kept").select(F.col("id").alias("pos")).join(lead, F.col("pos") == F.col("b"), "left").select("pos", "leader")


REF = "array<struct<source:string,url:string,trust_score:double,collected_at:string,title:string>>"


def dup_ref(title: str) -> Column:
    return F.struct(text(F.col("source")).alias("source"), text(F.col("url")).alias("url"), F.col("trust_score").cast("double").alias("trust_score"), text(F.col("collected_at")).alias("collected_at"), text(F.col(title)).alias("title"))


def attach(kept: DataFrame, dropped: DataFrame, ident: str, leader: str, title: str, order: str = "seq") -> DataFrame:
    """kept with dup_sources: its own, then each dropped row and that row's own, without blank or repeated URLs or the leader's."""
    dups = F.coalesce("dup_sources", F.array().cast(REF)) if "dup_sources" in dropped.columns else F.array().cast(REF)
    gone = dropped.select(F.col(leader).alias("__to"), F.col(order).alias("__o"), F.concat(F.array(dup_ref(title)).cast(REF), dups).alias("__refs"))
    own = F.coalesce("dup_sources", F.array().cast(REF)) if "dup_sources" in kept.columns else F.array().cast(REF)
    first = kept.select(F.col(ident).alias("__to"), F.lit(None).cast(dict(dropped.dtypes)[order]).alias("__o"), own.alias("__refs"))
    refs = first.union(gone).select("__to", "__o", F.posexplode("__refs").alias("__p", "ref"))
    one = refs.where("ref.url <> ''").groupBy("__to", "ref.url").agg(F.min_by("ref", F.struct(F.coalesce(F.col("__o").isNotNull().cast("int"), F.lit(0)), "__o", "__p")).alias("ref"), F.min(F.struct(F.col("__o").isNotNull().cast("int"), "__o", "__p")).alias("at"))
    listed = one.groupBy("__to").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("__dups"))
    out = kept.join(listed, kept[ident] == listed["__to"], "left")
    clean = F.filter(F.coalesce("__dups", F.array().cast(REF)), lambda r: r["url"] != text(F.col("url")))
    return out.withColumn("dup_sources", clean).drop("__to", "__dups")


def collapse(df: DataFrame, title: str = "title", order: str = "seq", days: int = WINDOW_DAYS) -> DataFrame:
    """The kept rows, in their columns and dup_sources; df needs source, url, trust_score, collected_at and order."""
    placed = checkpoint(df.withColumn("__key", F.struct(text(F.col("collected_at")), F.col(order))))
    lead = leaders(placed, title, "__key", days)
    joined = checkpoint(placed.join(lead, placed["__key"] == lead["pos"]).drop("pos"))
    kept, gone = joined.where("leader is null"), joined.where("leader is not null")
    return attach(kept, gone, "__key", "leader", title, "__key").drop("leader", "__key")


def story_groups(df: DataFrame, group: str = "story_group", title: str = "title", order: str = "seq") -> DataFrame:
    """Rows without a group, and of each group the row of greatest trust with the others in dup_sources."""
    rank = F.struct((-F.coalesce("trust_score", F.lit(0.0))).alias("t"), F.col(order).alias("o"))
    best = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(rank)["o"].alias("__leader"))
    joined = df.join(best, group, "left").withColumn("__rank", rank)
    kept = joined.where(F.col("__leader").isNull() | (F.col("__leader") == F.col(order)))
    gone = joined.where(F.col("__leader") != F.col(order))
    return attach(kept, gone, order, "__leader", title, "__rank").drop("__leader", "__rank")
