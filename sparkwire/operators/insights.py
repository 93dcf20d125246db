"""Hypotheses and their evidence: incremental input, validation, merging, and the read queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions.python import first_json_object
from sparkwire.functions.scores import confidence, document_quality, is_new, is_overdue, is_validated, source_kind
from sparkwire.functions.text import category, nz, text, title_tokens, trim
from sparkwire.functions.urls import news_id
from sparkwire.session import checkpoint, shuffles_dropped

from .dedupe import similar_pairs
from .windows import first_wins

LATEST = 60
REPLY = "hypotheses array<struct<statement:string,rationale:string,category:string,confidence:string,sources:array<struct<doc_id:string,excerpt:string,is_origin:boolean>>>>"


def news_snapshot(travel: DataFrame, packages: DataFrame) -> DataFrame:
    """Both archives as news rows, the first of each id."""
    a = travel.select(news_id(F.col("url"), F.col("article_hash")).alias("id"), F.col("title"), text(F.col("summary_ru")).alias("summary"), "url", "source", F.lit("travel").alias("origin"), text(F.col("case_type")).alias("case_type"), "collected_at", F.struct(F.lit(0), F.col("seq")).alias("o"))
    b = packages.select(news_id(F.col("url")).alias("id"), F.col("title"), F.lit("").alias("summary"), "url", "source", F.lit("packages").alias("origin"), F.lit("").alias("case_type"), "collected_at", F.struct(F.lit(1), F.col("seq")).alias("o"))
    return first_wins(a.unionByName(b), "id", "o").drop("o")


def unprocessed(docs: DataFrame, processed: DataFrame, order: list[Column], limit: int = LATEST, ident: str = "id") -> DataFrame:
    """Of the latest rows, those not yet processed: the limit comes before the anti-join."""
    return docs.orderBy(*order).limit(limit).join(processed.select(F.col("doc_id").alias("__d")), F.col(ident) == F.col("__d"), "left_anti")


def mark_processed(processed: DataFrame, ids: DataFrame, run_id: str, at: str) -> DataFrame:
    new = ids.select("doc_id").distinct().join(processed, "doc_id", "left_anti")
    return processed.unionByName(new.select("doc_id", F.lit(run_id).alias("first_run_id"), F.lit(at).alias("processed_at")))


def prompt(docs: DataFrame, head: str, most: int = 180_000, order: str = "seq") -> DataFrame:
    """One row: the head and each document with its line of facts, cut to `most` characters. docs is a limited batch."""
    line = F.concat(
        F.lit("\n--- DOC id="), "id", F.lit(" | kind="), F.coalesce(nz(F.col("kind")), F.lit("material")), F.lit(" | title="), text(F.col("title")),
        F.coalesce(F.concat(F.lit(" | source="), F.left(nz(F.col("source_ref")), F.lit(80))), F.lit("")),
        F.coalesce(F.concat(F.lit(" | tags="), nz(F.col("tags"))), F.lit("")), F.lit(" ---\n"), text(F.col("content")),
    )
    parts = docs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    whole = F.concat(F.lit(head), F.col("body"))
    return parts.select(F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("\n… [обрезано по лимиту]"))).otherwise(whole).alias("prompt"))


def parsed(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(run_id, pos, statement, rationale, category, confidence, sources) of each reply's first JSON object."""
    own = replies.select("run_id", F.from_json(first_json_object(F.col(raw)), REPLY).alias("x"))
    return own.select("run_id", F.posexplode("x.hypotheses").alias("pos", "h")).select(
        "run_id", "pos", trim(text(F.col("h.statement"))).alias("statement"), trim(text(F.col("h.rationale"))).alias("rationale"),
        category(F.col("h.category")).alias("category"), confidence(F.col("h.confidence")).alias("confidence"), F.col("h.sources").alias("sources"),
    )


def valid_evidence(hypotheses: DataFrame, valid: DataFrame) -> DataFrame:
    """(run_id, pos, doc_id, excerpt, is_origin, at): the first mention of each valid document."""
    rows = hypotheses.where("category <> '' and statement <> ''").select("run_id", "pos", F.posexplode("sources").alias("at", "s")).where("s.doc_id <> ''")
    rows = rows.select("run_id", "pos", "at", "s.doc_id", trim(F.left(text(F.col("s.excerpt")), F.lit(400))).alias("excerpt"), F.when(F.col("s.is_origin"), 1).otherwise(0).alias("is_origin"))
    return first_wins(rows, F.struct("run_id", "pos", "doc_id"), "at").join(valid.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def best_match(new: DataFrame, protected: DataFrame, threshold=(7, 10)) -> DataFrame:
    """(id, match, common, united): for each new (id, statement, category) the most similar protected row of its category.

    Ties go to the protected row of least pos.
    """
    a, b = (df.withColumn("tok", F.sort_array(title_tokens(F.col("statement")))) for df in (new, protected))
    pairs = similar_pairs(a.select("id", "tok"), b.select("id", "tok"), threshold)
    # classes of equal words meet, not rows: of protected copies the first, of new ones all share the match
    left = a.select("category", F.col("tok").alias("ta")).distinct()
    right = b.groupBy("category", F.col("tok").alias("tb")).agg(F.min_by(F.struct(F.col("id").alias("match"), "pos"), "pos").alias("r")).select("category", "tb", "r.*")
    rank = F.struct(-(F.col("common") / F.col("united")), "pos")
    best = left.join(pairs, "ta").join(right, ["tb", "category"]).groupBy("ta", "category").agg(F.min_by(F.struct("match", "common", "united"), rank).alias("m"))
    return a.select("id", "category", F.col("tok").alias("ta")).join(best, ["ta", "category"]).select("id", "m.*")


def store(hypotheses: DataFrame, evidence: DataFrame, replies: DataFrame, valid: DataFrame, at: str, append: bool) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, evidence) after a run's replies.

    Without append only hypotheses under review and beyond stay. A new one that is 0.7 similar to
    such a one of its category gives it its evidence instead of becoming a row.
    """
    protected = hypotheses.where(F.col("lifecycle_status").isin(*P.PROTECTED))
    if not append:
        evidence = evidence.join(protected.select(F.col("id").alias("hypothesis_id")), "hypothesis_id", "left_semi")
        hypotheses = protected
    new = parsed(replies)
    found = valid_evidence(new, valid)
    n = found.groupBy("run_id", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").startswith("news:")).alias("n_news"))
    new = new.drop("sources").join(n, ["run_id", "pos"]).withColumn("id", F.left(F.sha2(F.concat_ws("\n", "run_id", F.col("pos").cast("string"), "statement"), 256), F.lit(16)))
    ranked = protected.withColumn("pos", F.struct("created_at", "id"))
    match = best_match(new.select("id", "statement", "category"), ranked.select("id", "statement", "category", "pos"))
    placed = new.join(match, "id", "left")
    to = found.join(placed.select("run_id", "pos", F.coalesce("match", "id").alias("hypothesis_id")), ["run_id", "pos"])
    more = to.select("hypothesis_id", "doc_id", "excerpt", "is_origin", F.struct("run_id", "pos", "at").alias("o"))
    added = first_wins(more, F.struct("hypothesis_id", "doc_id"), "o").drop("o").join(evidence, ["hypothesis_id", "doc_id"], "left_anti")
    evidence = evidence.unionByName(added)
    counts = evidence.groupBy("hypothesis_id").agg(F.count("*").alias("n_now"))
    touched = match.select(F.col("match").alias("id")).distinct().withColumn("touched", F.lit(True))
    old = hypotheses.join(touched, "id", "left").join(counts, F.col("id") == F.col("hypothesis_id"), "left")
    old = old.withColumn("evidence_count", F.when(F.col("touched"), F.col("n_now")).otherwise(F.col("evidence_count"))).select(hypotheses.columns)
    rows = placed.where("match is null").select(
        "id", "statement", "rationale", "category", "confidence", is_validated(F.col("confidence")).alias("validated"), F.col("n").alias("evidence_count"),
        F.lit(at).alias("created_at"), "run_id", source_kind(F.col("n_news"), F.col("n")).alias("source_kind"), F.lit("synthesized").alias("lifecycle_status"), F.lit(at).alias("lifecycle_updated_at"),
    )
    return old.unionByName(rows, allowMissingColumns=True), evidence


def latest_run(runs: DataFrame, statuses=("ok", "done")) -> DataFrame:
    """One row, started_at of the latest finished run; only 'ok' is the strict form."""
    done = runs.where(F.col("finished_at").isNotNull() & F.col("status").isin(*statuses))
    return done.agg(F.coalesce(F.max("started_at"), F.lit("")).alias("started_at"))


def with_evidence(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds n_evidence (the stored count where there is no evidence) and kind."""
    n = evidence.groupBy(F.col("hypothesis_id").alias("__h")).agg(F.count_distinct("doc_id").alias("__n"), F.count_distinct(F.when(F.col("doc_id").startswith("news:"), F.col("doc_id"))).alias("__news"))
    out = hypotheses.join(n, F.col("id") == F.col("__h"), "left")
    derived = source_kind(F.coalesce("__news", F.lit(0)), F.coalesce("__n", F.lit(0)))
    kind = F.when(F.col("source_kind").isin("material", "news", "mixed"), F.col("source_kind")).otherwise(derived) if "source_kind" in hypotheses.columns else derived
    return out.withColumn("n_evidence", F.coalesce(F.when(F.col("__n") > 0, F.col("__n")), F.col("evidence_count"))).withColumn("kind", kind).drop("__h", "__n", "__news")


def listing(hypotheses: DataFrame, evidence: DataFrame, section: str | None = None, kind: str | None = None) -> DataFrame:
    """All, by validation, evidence and confidence; an unknown section or kind is no filter."""
    out = with_evidence(hypotheses, evidence)
    name = P.SECTIONS.get(section or "", section)
    if name in P.CATEGORIES:
        out = out.where(F.col("category") == name)
    if kind in ("material", "news", "mixed"):
        out = out.where(F.col("kind") == kind)
    return out.orderBy(F.desc("validated"), F.desc("n_evidence"), F.desc("confidence"), "id")


def section(hypotheses: DataFrame, evidence: DataFrame, name: str, limit: int = 5) -> DataFrame:
    out = with_evidence(hypotheses.where(F.col("category") == P.SECTIONS.get(name, name)), evidence)
    return out.orderBy(F.desc("validated"), F.desc("confidence"), F.desc("created_at"), "id").limit(max(1, min(20, limit)))


def counts(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """(what, name, n): rows by kind and by category, each category there."""
    own = with_evidence(hypotheses, evidence)
    kinds = own.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), F.col("kind").alias("name"), "n")
    names = hypotheses.sparkSession.createDataFrame([(c,) for c in P.CATEGORIES], "name string")
    by = own.groupBy("category").agg(F.count("*").alias("n"))
    return kinds.union(names.join(by, F.col("name") == F.col("category"), "left").select(F.lit("category"), "name", F.coalesce("n", F.lit(0))))


def mine(hypotheses: DataFrame, user: str, as_of: str, latest: str = "") -> DataFrame:
    """The user's hypotheses and those of the day: overdue, next check, new, oldest first."""
    today = as_of[:10]
    owned = F.lower(text(F.col("owner_username"))) == user.lower()
    rows = hypotheses.where(owned | (F.left(text(F.col("created_at")), F.lit(10)) == today))
    rows = rows.withColumn("overdue", is_overdue(F.col("next_check_at"), F.lit(today))).withColumn("is_new", is_new(F.col("created_at"), F.to_timestamp(F.lit(as_of)), F.lit(latest)))
    return rows.orderBy(F.desc("overdue"), F.coalesce(nz(F.col("next_check_at")), F.lit("9999-99-99")), F.desc("is_new"), "created_at", "id")


def mine_counters(rows: DataFrame, user: str) -> DataFrame:
    owned = F.lower(text(F.col("owner_username"))) == user.lower()
    return rows.agg(F.count_if(owned & (F.col("lifecycle_status") == "in_review")).alias("in_review"), F.count_if(owned & F.col("overdue")).alias("overdue"), F.count_if("is_new").alias("new"), F.count("*").alias("total"))


def badge(hypotheses: DataFrame, user: str, today: str) -> DataFrame:
    """One row: the user's hypotheses in review or overdue, each once."""
    owned = F.lower(text(F.col("owner_username"))) == user.lower()
    review = F.coalesce(F.col("lifecycle_status") == "in_review", F.lit(False))
    return hypotheses.agg(F.count_if(owned & (review | is_overdue(F.col("next_check_at"), F.lit(today)))).alias("n"))


def detail(ident: str, hypotheses: DataFrame, evidence: DataFrame, docs: DataFrame, news: DataFrame) -> DataFrame:
    """The evidence of one hypothesis with titles and quality, origins first."""
    own = evidence.where(F.col("hypothesis_id") == ident).join(hypotheses.select(F.col("id").alias("hypothesis_id"), "statement"), "hypothesis_id")
    d = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("d_title"), document_quality(F.col("content"), F.col("source_type"), F.col("source_ref")).alias("q"))
    n = news.select(F.col("id").alias("doc_id"), F.col("title").alias("n_title"), "url")
    out = own.join(d, "doc_id", "left").join(n, "doc_id", "left")
    is_news = F.col("doc_id").startswith("news:")
    title = F.when(is_news, F.coalesce(nz(F.col("n_title")), F.lit("(новость удалена)"))).otherwise(F.coalesce(nz(F.col("d_title")), F.lit("(документ удалён)")))
    quality = F.when(is_news, F.when(F.col("n_title").isNotNull(), "amber").otherwise("red")).otherwise(F.coalesce("q.level", F.lit("red")))
    return out.select("doc_id", title.alias("title"), "url", "excerpt", "is_origin", quality.alias("quality")).orderBy(F.desc("is_origin"), "doc_id")


#: Rows, and pairs of nodes, that one task takes; an item of more nodes is met in blocks of so many.
TASK_ROWS, TASK_PAIRS, BLOCK = 1 << 21, 1 << 21, 1 << 11

#: A node of at most so many items can take the others along to each of them; so many items' blocks are broadcast.
LIGHT, BROADCAST = 1 << 5, 1 << 16


def _tasks(df: DataFrame, n: float, most: int) -> int:
    """Tasks for n rows of `most` each, and one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / most))


def _rows(evidence: DataFrame, node: str, item: str) -> DataFrame:
    return evidence.select(F.col(node).alias("n"), F.col(item).alias("i")).where(F.col("n").isNotNull() & F.col("i").isNotNull())


def _items(rows: DataFrame) -> tuple[DataFrame, int]:
    """(n, i): the distinct items of each node, in tasks of bounded size; the number of rows."""
    with shuffles_dropped(rows.sparkSession):
        n_rows = rows.count()
    return rows.repartition(_tasks(rows, n_rows, TASK_ROWS), "i", "n").distinct(), n_rows


def _shared(rows: DataFrame, own: DataFrame, n_rows: int) -> DataFrame:
    """(a, b, w), a < b, of own, distinct (n, i), which may repeat in rows; pairs are counted before they are formed.

    A pair's sum takes a row in a shuffle for each item that the two share. A light node's other items, taken
    along to each of its items, give the sum where the pair first meets, and no pair is shuffled; light
    nodes go that way if they then shuffle less. Pairs of a heavy node are summed, as are all pairs where
    lists would tell items apart that a join takes for one (0.0 and -0.0).
    """
    d, light, c = F.col("d").cast("double"), F.col("d") <= LIGHT, F.col("c").cast("double")
    degrees, counts = own.groupBy("n").agg(F.count("*").alias("d")), own.groupBy("i").agg(F.count("*").alias("c"))
    heavy = degrees.where(~light).select("n", F.lit(1).alias("heavy"))
    marked = own.join(heavy, "n", "left")
    total = F.sum(c * (c - 1) / 2)
    with shuffles_dropped(own.sparkSession):
        sums = degrees.agg(F.sum(F.when(light, d * (d + 1))).alias("listed"), F.count_if(~light).alias("n_heavy"))
        listed, n_heavy, pairs, n_crowds = sums.crossJoin(counts.agg(total.alias("pairs"), F.count_if(F.col("c") > BLOCK).alias("n_crowds"))).first()
        pairs = once = pairs or 0
        if listed and n_heavy:
            once = marked.where("heavy is null").groupBy("i").agg(F.count("*").alias("c")).agg(total).first()[0]
    crowds = counts.where(F.col("c") > BLOCK) if n_crowds else None
    if crowds is not None and n_crowds <= BROADCAST:
        crowds = F.broadcast(crowds)
    if not listed or listed >= 2 * once or any(kind in dict(own.dtypes)["i"] for kind in ("float", "double", "collate")):
        return _summed(_met(own, crowds, _tasks(own, pairs, TASK_PAIRS)).where("a < b"), pairs)
    rows = rows.join(heavy, "n", "left_anti") if n_heavy else rows
    sets = rows.repartition(_tasks(rows, n_rows, TASK_ROWS), "n").groupBy("n").agg(F.collect_set("i").alias("s"))
    each = sets.select("n", F.explode("s").alias("i"), "s").withColumn("s", F.array_remove("s", F.col("i")))
    met = _met(each, crowds, _tasks(own, once, TASK_PAIRS), "s")
    again, others = F.arrays_overlap("a_s", "b_s"), F.array_intersect("a_s", "b_s")
    out = met.where((F.col("a") < F.col("b")) & (~again | (F.col("i") < F.array_min(others))))
    out = out.select("a", "b", F.when(again, F.size(others) + 1).otherwise(1).cast("long").alias("w"))
    if not n_heavy:
        return out
    met = _met(marked, crowds, _tasks(own, pairs - once, TASK_PAIRS), "heavy").where("a_heavy = 1 and (b_heavy is null or a < b)")
    return out.union(_summed(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), pairs - once))


def _met(own: DataFrame, crowds: DataFrame | None, n: int, carried: str | None = None) -> DataFrame:
    """(a, b, i): any two nodes of own at each of their items, both ways and each with itself, in n tasks; a_ and b_ what is carried.

    An item of crowds is dealt into blocks of BLOCK nodes, any two of which meet in a cell (x, y), x <= y.
    """
    on, more, apart = ["i"], [carried] if carried else [], F.lit(True)
    if crowds is not None:
        on, more, apart = ["i", "x", "y"], [*more, "block"], F.expr("x = y or a_block <> b_block")
        own = own.join(crowds.select("i", F.ceil(F.col("c") / BLOCK).alias("k")), "i", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long")))
        own = own.withColumn("block", F.pmod(F.xxhash64("n"), "k")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        own = own.withColumn("x", F.least("block", "j")).withColumn("y", F.greatest("block", "j"))
    dealt = own.select("n", *on, *more).repartition(n, *on)
    left, right = (dealt.select(F.col("n").alias(side), *on, *[F.col(m).alias(f"{side}_{m}") for m in more]) for side in "ab")
    return left.join(right, on).where(apart)


def _summed(met: DataFrame, pairs: float) -> DataFrame:
    """(a, b, w) of the pairs met, shuffled as they are: few occur twice in a task, and a sum before the shuffle would hold nearly all of a task's."""
    return met.select("a", "b").repartition(_tasks(met, pairs, TASK_PAIRS), "a", "b").groupBy("a", "b").agg(F.count("*").alias("w"))


def graph(evidence: DataFrame, node: str = "hypothesis_id", item: str = "doc_id") -> DataFrame:
    """(a, b, w): pairs of nodes, a < b, with the number of items they share.

    Nodes meet on items in one join, whose tasks grow in number with the pairs and not in size; an item
    that very many nodes share is dealt over several. The relation itself has a row for each pair that
    shares an item; where only neighbours are asked for, neighbours() takes no pairs.
    """
    rows = _rows(evidence, node, item)
    return _shared(rows, *_items(rows))


def graph_classes(evidence: DataFrame, node: str = "hypothesis_id", item: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """graph() without its repetitions: classes (node, class_id, n_nodes, n_items), and links (a, b, w) between classes.

    Nodes of the same items are one class, named by its least node; any two of a class share n_items, and
    any two of linked classes w. So a crowd of like nodes makes a row each, and no pairs. Item sets are
    compared by their count and two sums of hashes that are added up in any order.
    """
    own, n_rows = _items(_rows(evidence, node, item))
    h = [F.xxhash64(F.lit(k), "i") for k in (1, 2)]
    marks = own.groupBy("n").agg(F.count("*").alias("n_items"), *[F.bit_xor(x).alias(f"x{k}") for k, x in enumerate(h)], *[F.sum(F.shiftright(x, 32)).alias(f"s{k}") for k, x in enumerate(h)])
    marks = checkpoint(marks)
    key = ["n_items", "x0", "x1", "s0", "s1"]
    sets = marks.groupBy(*key).agg(F.min("n").alias("class_id"), F.count("*").alias("n_nodes"))
    classes = checkpoint(marks.join(sets, key).select(F.col("n").alias("node"), "class_id", "n_nodes", "n_items"))
    first = own.join(classes.where("node = class_id").select(F.col("node").alias("n")), "n", "left_semi")
    return classes, _shared(first, first, n_rows)


def strongest(evidence: DataFrame, shown: DataFrame, most: int = 20, node: str = "hypothesis_id", item: str = "doc_id") -> DataFrame:
    """(node, other, w, rank) of the shown nodes (id): the `most` other nodes with which each shares the most items.

    Only the shown nodes' items are met, and pairs are made for them alone.
    """
    own = evidence.select(F.col(node).alias("n"), F.col(item).alias("i")).distinct()
    met = own.join(shown.select(F.col("id").alias("n")).distinct(), "n", "left_semi").select(F.col("n").alias("node"), "i")
    pairs = met.join(own, "i").where(F.col("node") != F.col("n")).groupBy("node", F.col("n").alias("other")).agg(F.count("*").alias("w"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def neighbours(evidence: DataFrame, nodes: DataFrame, pattern: str, node: str = "hypothesis_id", item: str = "doc_id") -> DataFrame:
    """Ids of nodes with the words, and of those that share an item with one, by their items and without edges."""
    hits = _with_words(nodes, pattern)
    own = evidence.select(F.col(node).alias("id"), F.col(item).alias("i"))
    items = own.join(hits, "id", "left_semi").select("i").distinct()
    return hits.union(own.join(items, "i", "left_semi").select("id")).distinct()


def _with_words(nodes: DataFrame, pattern: str) -> DataFrame:
    return nodes.where(F.lower(F.concat(text(F.col("statement")), F.lit(" "), text(F.col("rationale")))).contains(pattern.lower())).select("id")


def neighbourhood(edges: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Ids of nodes with the words, and of their neighbours."""
    hits = _with_words(nodes, pattern)
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return hits.union(both.join(hits, F.col("a") == F.col("id"), "left_semi").select("b")).distinct()


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")


def page(rows: DataFrame, n: int, size: int = 30) -> DataFrame:
    return rows.offset(n * size).limit(size)


def board(hypotheses: DataFrame) -> DataFrame:
    """Rows of each lifecycle status, each status there."""
    names = hypotheses.sparkSession.createDataFrame([(s,) for s in P.TRANSITIONS], "status string")
    by = hypotheses.groupBy("lifecycle_status").agg(F.count("*").alias("n"))
    return names.join(by, F.col("status") == F.col("lifecycle_status"), "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def filtered(hypotheses: DataFrame, archived: bool = False, category: str | None = None, kind: str | None = None, view: str | None = None) -> DataFrame:
    """What a page shows: archived rows or all others, then the filters that are set; view is 'validated' or 'single'."""
    is_archived = F.coalesce(nz(F.col("lifecycle_status")), F.lit("synthesized")) == "archived"
    out = hypotheses.where(is_archived if archived else ~is_archived)
    if category:
        out = out.where(F.col("category") == category)
    if kind:
        out = out.where(F.coalesce(nz(F.col("source_kind")), F.lit("material")) == kind)
    if view == "validated":
        out = out.where(F.col("validated") != 0)
    elif view == "single":
        out = out.where(F.col("evidence_count") <= 1)
    return out


def header(hypotheses: DataFrame) -> DataFrame:
    """One row: all, validated and single-source hypotheses, and the two views' sizes."""
    archived = F.coalesce(nz(F.col("lifecycle_status")), F.lit("synthesized")) == "archived"
    return hypotheses.agg(
        F.count("*").alias("total"), F.count_if(F.col("validated") != 0).alias("validated"), F.count_if(F.col("evidence_count") <= 1).alias("single"),
        F.count_if(~archived).alias("asis"), F.count_if(archived).alias("archive"),
    )


def job_inputs(docs: DataFrame, news: DataFrame, processed: DataFrame, limit: int = LATEST, most: int = 2400) -> DataFrame:
    """The latest approved materials and news, each `limit` before those already processed are left out.

    (id, kind, title, source_type, source_ref, tags, content, seq): seq is the order of a prompt,
    materials first, the newest first.
    """
    body = lambda c: F.when(F.length(c) > most, F.concat(F.regexp_replace(F.left(c, F.lit(most)), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(c)
    a = docs.where("moderation_status = 'approved'").select("id", F.lit("material").alias("kind"), "title", "source_type", text(F.col("source_ref")).alias("source_ref"), text(F.col("tags")).alias("tags"), trim(text(F.col("content"))).alias("content"), text(F.col("created_at")).alias("at"))
    parts = F.array(nz(F.col("summary")), F.when(nz(F.col("case_type")).isNotNull(), F.concat(F.lit("Тип: "), "case_type")))
    told = F.coalesce(nz(trim(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))), F.col("title"))
    tags = F.regexp_replace(F.concat(F.lit("news,"), text(F.col("origin"))), "^,+|,+$", "")
    b = news.select("id", F.lit("news").alias("kind"), "title", F.lit("news").alias("source_type"), F.coalesce(nz(F.col("source")), F.col("url")).alias("source_ref"), tags.alias("tags"), told.alias("content"), text(F.col("collected_at")).alias("at"))
    both = unprocessed(a, processed, [F.desc("at"), F.col("id")], limit).unionByName(unprocessed(b, processed, [F.desc("at"), F.col("id")], limit))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at"), "id"))  # `limit` rows of a kind at most
    return both.withColumn("seq", F.struct((F.col("kind") == "news").alias("late"), rank.alias("rank"))).withColumn("content", body(F.col("content"))).drop("at")


def insight_job(docs: DataFrame, news: DataFrame, hypotheses: DataFrame, evidence: DataFrame, processed: DataFrame, model, run_id: str, at: str, head: str = "") -> dict[str, DataFrame]:
    """One run: new materials and news, one prompt, the model's reply, what it stores, and the run's row.

    model(prompts) gives (run_id, raw) for rows (run_id, prompt): any backend over a DataFrame. Without
    new sources or without a reply that can be read nothing is stored and the run's status is 'error'.
    """
    inputs = checkpoint(job_inputs(docs, news, processed))
    n = {r["kind"]: r["n"] for r in inputs.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # bounded: two kinds
    total, error = sum(n.values()), None
    first = processed.isEmpty()
    after = {"hypotheses": hypotheses, "evidence": evidence, "processed": processed}
    proposed = validated = 0
    if not total:
        error = "no new sources"
    else:
        prompts = prompt(inputs, head).select(F.lit(run_id).alias("run_id"), "prompt")
        replies = checkpoint(model(prompts).select("run_id", "raw"))
        if not replies.where(F.from_json(first_json_object(F.col("raw")), REPLY)["hypotheses"].isNotNull()).count():
            error = "no reply with hypotheses"
        else:
            h, e = store(hypotheses, evidence, replies, inputs.select("id"), at, append=not first)
            h, e = checkpoint(h), checkpoint(e)
            row = h.where(F.col("run_id") == run_id).agg(F.count("*"), F.count_if(F.col("validated") == 1)).first()
            proposed, validated = row[0], row[1]
            after = {"hypotheses": h, "evidence": e, "processed": mark_processed(processed, inputs.select(F.col("id").alias("doc_id")), run_id, at)}
    row = (run_id, at, at, "error" if error else "done", total, proposed, validated, error, n.get("material", 0), n.get("news", 0), not first)
    kind = "id string, started_at string, finished_at string, status string, docs_total long, hypotheses_total long, validated_total long, error string, new_materials long, new_news long, incremental boolean"
    return after | {"run": docs.sparkSession.createDataFrame([row], kind)}
