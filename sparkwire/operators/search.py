"""Full-text search over a table or an inverted index: prefix terms and phrases, all of them, ranked by BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.session import checkpoint

K1, B = 1.2, 0.75
#: Letters with marks and their bare forms, for matching without diacritics.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿёй"
BARE = "aaaaaaceeeeiiiinoooooouuuuyyеи"


def tokens(col: Column) -> Column:
    low = F.translate(F.lower(F.coalesce(col, F.lit(""))), MARKED, BARE)
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index(docs: DataFrame, ident: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf, at) and (id, length) over all columns; at: the term's places in order.

    A column's first word does not follow the last word of the column before.
    """
    own = docs.select(F.col(ident).alias("id"), _words(columns).alias("words"))
    places = own.select("id", F.posexplode("words").alias("at", "term")).where(F.col("term").isNotNull())
    postings = places.groupBy("id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))
    return postings, own.select("id", (F.size("words") - (len(columns) - 1)).alias("length"))


def _words(columns: list[str]) -> Column:
    """The words of all columns, a null between two columns."""
    parts = [x for c in columns for x in (F.array(F.lit(None).cast("string")), tokens(F.col(c)))]
    return F.concat(*parts[1:])


def reindexed(postings: DataFrame, lengths: DataFrame, changed: DataFrame, ids: DataFrame, ident: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The index after documents were added, changed or (where `changed` lacks them) deleted; ids has column id."""
    new_postings, new_lengths = index(changed, ident, columns)
    return postings.join(ids, "id", "left_anti").unionByName(new_postings), lengths.join(ids, "id", "left_anti").unionByName(new_lengths)


def stored(postings: DataFrame, lengths: DataFrame, path: str) -> None:
    """Writes an index, postings in ranges of terms, so that a prefix reads few files' row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def phrases_of(query: str) -> list[list[str]]:
    """The first twelve terms of a query without diacritics, each cut where the index cuts.

    A term of several parts ("e-mail") is a phrase: its parts stand side by side, the last one is a prefix.
    """
    terms = [t.translate(str.maketrans(MARKED, BARE)) for t in re.findall(r"[\w\-]+", (query or "").lower())[:12]]
    parts = [tuple(re.findall(r"[^\W_]+", t)) for t in terms]
    return [list(p) for p in dict.fromkeys(parts) if p]


def search(docs: DataFrame, ident: str, columns: list[str], query: str, limit: int = 30, visible: Column | None = None, digits: int | None = None) -> DataFrame:
    """(id, score): documents that have every term of the query, a word by its prefix or a phrase; the least score is the best.

    With digits, scores are rounded before they are ranked, so that equal ones are in order of id.

    A prefix's frequency is the number of its words in a document, a phrase's that of its places, and a
    document frequency the number of documents with one. For a table without an index: each text is cut
    into words once, and only counts leave the scan.
    """
    phrases = phrases_of(query)
    if not phrases:
        return docs.limit(0).select(F.col(ident).alias("id"), F.lit(0.0).alias("score"))
    span = max(map(len, phrases))
    # bound in a lambda, the words are not cut again for each of the places that name them
    runs = F.transform(F.array(_words(columns)), lambda words: F.transform(words, lambda w, i: F.array(w, *[F.get(words, i + k) for k in range(1, span)])))[0]
    own = docs.select(F.col(ident).alias("id"), (F.lit(True) if visible is None else visible).alias("visible"), F.explode_outer(runs).alias("w"))
    word = lambda k: F.get("w", F.lit(k))
    hit = lambda p: reduce(lambda a, b: a & b, [word(k) == x for k, x in enumerate(p[:-1])] + [word(len(p) - 1).startswith(p[-1])])
    counts = own.groupBy("id", "visible").agg(F.count(word(0)).alias("length"), *[F.count_if(hit(p)).alias(f"tf{k}") for k, p in enumerate(phrases)])
    counts = checkpoint(counts)  # a few numbers a document, read for the statistics and for the scores
    return _ranked(counts, counts.agg(*_stats(len(phrases))).first(), len(phrases), limit, digits)


def search_index(postings: DataFrame, lengths: DataFrame, query: str, limit: int = 30, visible: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """search() over an index; visible has the ids that may be shown. The terms' ranges are pushed to the scan of postings.

    A phrase's places are those of its first part that all other parts follow: the parts' sorted places,
    each moved back by its part's number, are intersected within a document. Postings without places (at)
    do for queries without phrases.
    """
    phrases = phrases_of(query)
    if not phrases:
        return lengths.limit(0).select("id", F.lit(0.0).alias("score"))
    term = F.col("term")
    starts = lambda t: (term >= t) & (term < t + "\U0010ffff")
    within = reduce(lambda a, b: a | b, [m for p in phrases for m in (*[term == x for x in p[:-1]], starts(p[-1]))])
    sums = []
    for k, p in enumerate(phrases):
        if len(p) == 1:
            sums.append(F.sum(F.when(term.startswith(p[0]), F.col("tf")).otherwise(0)).alias(f"tf{k}"))
            continue
        matches = [*[term == x for x in p[:-1]], term.startswith(p[-1])]
        places = [F.flatten(F.collect_list(F.when(m, _back("at", n)))) for n, m in enumerate(matches)]
        sums.append(F.size(reduce(F.array_intersect, places)).cast("long").alias(f"tf{k}"))
    hits = checkpoint(postings.where(within).groupBy("id").agg(*sums))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first().asDict() | hits.agg(*_stats(len(phrases))[2:]).first().asDict()
    found = hits.where(" and ".join(f"tf{k} > 0" for k in range(len(phrases)))).join(lengths, "id").withColumn("visible", F.lit(True))
    return _ranked(found if visible is None else found.join(visible, "id", "left_semi"), stats, len(phrases), limit, digits)


def _back(places: str, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _stats(n: int) -> list[Column]:
    return [F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(n)]]


def _ranked(counts: DataFrame, stats, n: int, limit: int, digits: int | None = None) -> DataFrame:
    parts = []
    for k in range(n):
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(stats["n"]) - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)))
        f = F.col(f"tf{k}").cast("double")
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"]))))
    every = reduce(lambda a, b: a & b, [F.col(f"tf{k}") > 0 for k in range(n)])
    score = -reduce(lambda a, b: a + b, parts)
    score = score if digits is None else F.round(score, digits)
    return counts.where(every & F.col("visible")).select("id", score.alias("score")).orderBy("score", "id").limit(max(1, min(100, limit)))


def snippet(col: Column, terms: list[str], words: int = 24, begin: str = "<mark>", end: str = "</mark>") -> Column:
    """About `words` words around the first hit, hits marked; a term of several parts marks the words its phrase begins in."""
    parts = F.split(F.coalesce(col, F.lit("")), r"\s+")
    gap = r"[^\p{L}\p{N}]+"
    patterns = [(len(p), r"^\S*?(?<![\p{L}\p{N}])" + gap.join(map(re.escape, p))) for t in terms for p in phrases_of(t)]

    def hits(listed: Column) -> Column:
        low = F.transform(listed, lambda w: F.translate(F.lower(w), MARKED, BARE))
        run = lambda all_, w, i, n: w if n == 1 else F.array_join(F.slice(all_, i + 1, F.lit(n)), " ")
        every = lambda all_: F.transform(all_, lambda w, i: reduce(lambda a, b: a | b, [run(all_, w, i, n).rlike(p) for n, p in patterns], F.lit(False)))
        return F.transform(F.array(low), every)[0]

    at = F.array_position(hits(parts), True).cast("int")
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - words // 4)
    marked = F.zip_with(F.slice(parts, start, words), F.slice(hits(parts), start, words), lambda w, h: F.when(h, F.concat(F.lit(begin), w, F.lit(end))).otherwise(w))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(start + words <= F.size(parts), "…").otherwise(""))
