"""The batch flows: from feed items to rated stories, and from stubs to candidates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions.scores import is_fresh
from sparkwire.functions.text import classify, nz, on_topic, rate, strip_tags, text, trim, without_antibot
from sparkwire.functions.urls import GOOD, normalize, resolved, shape, with_trust
from sparkwire.operators import documents
from sparkwire.operators.archive import merge_candidates
from sparkwire.operators.dedupe import collapse
from sparkwire.operators.documents import merged_summaries
from sparkwire.operators.windows import first_wins, round_robin
from sparkwire.session import checkpoint

BUDGET, LEAST_TRUST = 320, 0.30


def demo(entries: DataFrame, registry: DataFrame, collected_at: str, topics: dict | None = None, per_feed: int = 25) -> DataFrame:
    """Feed entries (seq, feed, pos, title, link, summary, full_text) as rated stories of travel news.

    Topics are judged before the full text is taken in; near-duplicates are attached to the first.
    """
    rows = entries.where((F.col("pos") <= per_feed) & (trim(text(F.col("title"))) != ""))
    short = strip_tags(F.col("summary"))
    rows = rows.select("seq", trim(F.col("title")).alias("title"), F.coalesce(nz(F.col("link")), F.col("feed")).alias("url"), F.col("feed").alias("source"), short.alias("summary_src"), nz(F.col("full_text")).alias("full_text"))
    rows = checkpoint(rows)  # clean texts: what follows names them many times
    rows = rows.withColumn("case_type", classify(F.col("title"), F.col("summary_src"), **(topics or {}))).where(F.col("case_type") != P.NONE)
    rows = with_trust(rows, "url", registry).withColumn("collected_at", F.lit(collected_at))
    rows = rows.withColumn("text", F.coalesce("full_text", "summary_src")).withColumn("fetch_mode", F.when(F.col("full_text").isNotNull(), "full").otherwise("summary")).drop("full_text")
    rows = checkpoint(rows)
    # only what the collapse reads goes through it; the bodies come back once
    kept = collapse(rows.select("seq", "title", "url", "source", "trust_score", "collected_at"), "title", "seq")
    rows = rows.join(kept.select("seq", "dup_sources"), "seq")
    rating = rate(F.col("title"), F.col("text"), F.col("case_type"))
    return rows.withColumn("r", rating).select("seq", "title", "url", "source", "case_type", "trust_score", "trust_matched_domain", "fetch_mode", F.col("r.summary").alias("summary"), F.col("r.rating").alias("rating"), "dup_sources", "collected_at")


def report(stories: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """The topics' counts and the best stories."""
    counts = stories.groupBy("case_type").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").drop("first")
    return {"topics": counts, "top": stories.orderBy(F.desc("trust_score"), F.desc("rating"), "seq").limit(top)}


def judged(hits: DataFrame, as_of: str, shapes: dict | None = None, gate: dict | None = None) -> DataFrame:
    """Hits (seq, title, url, source, query, pub, snippet) with the reason each is dropped for, or 'stubbed'."""
    rows = hits.withColumn("__bad", ~shape(F.col("url"), **(shapes or {})).isin(*GOOD)).withColumn("__on", on_topic(F.col("title"), F.col("snippet"), F.col("query"), **(gate or {})))
    rows = rows.withColumn("__fresh", is_fresh(F.col("pub"), F.to_timestamp(F.lit(as_of)))).withColumn("__norm", normalize(F.col("url")))
    first = rows.where("__fresh and not __bad and __on").groupBy("__norm").agg(F.min("seq").alias("__first"))
    reason = F.when(~F.col("__fresh"), "stale").when(F.col("__bad"), "bad_shape").when(~F.col("__on"), "offtopic").when(F.col("seq") != F.col("__first"), "deduped").otherwise("stubbed")
    return rows.join(first, "__norm", "left").withColumn("reason", reason).drop("__bad", "__on", "__fresh", "__norm", "__first")


def stubs(hits: DataFrame, as_of: str, **options) -> DataFrame:
    return judged(hits, as_of, **options).where("reason = 'stubbed'").drop("reason")


def funnel(hits: DataFrame, as_of: str, **options) -> DataFrame:
    return judged(hits, as_of, **options).groupBy("reason").agg(F.count("*").alias("n"))


def resolve(rows: DataFrame, redirects: DataFrame, texts: DataFrame, registry: DataFrame, aggregator: str = r"^https?://news\.google\.com/", topics: dict | None = None) -> DataFrame:
    """Stubs as candidates: where they lead, their trust, their text (only from trusted places), their topic.

    Unresolved aggregator links go; long texts without a topic go, short ones stay for the next stage.
    """
    out = rows.join(redirects.select(F.col("url"), F.col("final_url").alias("__final")), "url", "left")
    out = out.withColumn("url", resolved(F.col("url"), F.col("__final"), F.col("url").rlike(aggregator))).where("url <> ''").drop("__final")
    out = with_trust(out, "url", registry)
    out = out.join(texts.select(F.col("url"), F.col("text").alias("__text")), "url", "left")
    body = F.when(F.col("trust_score") >= LEAST_TRUST, without_antibot(text(F.col("__text")))).otherwise("")
    out = out.withColumn("article_text", body).drop("__text").withColumn("case_type", F.nullif(classify(F.col("title"), F.col("article_text"), **(topics or {})), F.lit(P.NONE)))
    return out.where(F.col("case_type").isNotNull() | (F.length("article_text") < 300))


def collect(hits: DataFrame, existing: DataFrame, redirects: DataFrame, texts: DataFrame, registry: DataFrame, as_of: str, budget: int = BUDGET, **options) -> DataFrame:
    """A collection run: the candidate list after its hits."""
    picked = round_robin(stubs(hits, as_of, **options), budget)
    found = first_wins(resolve(picked, redirects, texts, registry), normalize(F.col("url")))
    rows = found.select("seq", F.col("title").alias("title_en"), "url", "source", "query", "pub", "article_text", "trust_score", "trust_matched_domain", "case_type")
    return merge_candidates(existing, rows)


def trust_tiers(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(F.round("trust_score", 2).alias("tier")).agg(F.count("*").alias("n")).orderBy(F.desc("tier"))


def prefetch_targets(candidates: DataFrame, most: int = 200, least: int = 200) -> DataFrame:
    """Candidates that lack text, the most trusted first; no trust or none known counts as 0.1."""
    trust = F.coalesce(F.nullif(F.col("trust_score"), F.lit(0.0)), F.lit(0.1))
    return candidates.orderBy(F.desc(trust), "seq").limit(most).where(F.length(trim(text(F.col("article_text")))) < least)


def with_texts(candidates: DataFrame, fetched: DataFrame, cut: int = 2500) -> DataFrame:
    """Candidates with fetched (url, text) where that is there."""
    got = fetched.where(trim(text(F.col("text"))) != "").select("url", F.left("text", F.lit(cut)).alias("__t"))
    return candidates.join(got, "url", "left").withColumn("article_text", F.coalesce("__t", "article_text")).drop("__t")


def prefetch(candidates: DataFrame, fetched: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Candidates with texts by the tiers of fetched (url, direct, page, snippets, paid), and the count of each mode."""
    targets = prefetch_targets(candidates, most)
    got = checkpoint(documents.fetched(targets.select("url", "trust_score").join(fetched, "url", "left"), documents.PREFETCH))
    return with_texts(candidates, got.select("url", "text").dropDuplicates(["url"])), documents.modes(got)


def lacking(items: DataFrame, least_trust: float = 0.0) -> DataFrame:
    """Items without a summary, of at least that trust."""
    return items.where((trim(text(F.col("summary_ru"))) == "") & (F.coalesce("trust_score", F.lit(0.0)) >= least_trust))


def summary_targets(items: DataFrame, most: int = 35, least_trust: float = 0.0) -> DataFrame:
    """Items to be fetched: the most trusted of those that lack a summary. The limit is one on fetching, not on summaries."""
    return lacking(items, least_trust).orderBy(F.desc(F.coalesce("trust_score", F.lit(0.0))), "seq").limit(most)


def summary_batch(items: DataFrame, fetched: DataFrame, most: int = 35, least_trust: float = 0.0, cut: int = 2500) -> DataFrame:
    """(id, title, text, mode) of every item that lacks a summary.

    The text is the item's own, or else that of fetched (url and the tiers' columns) for the `most` most
    trusted, or else is made of the title and the reasons the item was taken for; mode tells which.
    """
    rows = lacking(items, least_trust)
    targets = summary_targets(items, most, least_trust).where(nz(F.col("url")).isNotNull()).select("seq", "url", "trust_score")
    got = documents.rescued(targets.join(fetched, "url", "left")).select("seq", F.col("text").alias("__text"), F.col("mode").alias("__mode"))
    reasons = [trim(text(F.col(c))) for c in ("title", "relevance_reason", "bank_applicability_reason") if c in items.columns]
    fallback = F.array_join(F.filter(F.array(*reasons), lambda x: x != ""), ". ")
    own, there = nz(trim(text(F.col("article_text")))), nz(F.col("__text"))
    mode = F.when(own.isNotNull(), "own").when(there.isNotNull(), F.col("__mode")).otherwise("fallback")
    return rows.join(got, "seq", "left").select(F.col("seq").alias("id"), "title", F.left(F.coalesce(own, there, fallback), F.lit(cut)).alias("text"), mode.alias("mode"))


def summarised(items: DataFrame, fetched: DataFrame, model, most: int = 35, least: int = 200, least_trust: float = 0.0) -> DataFrame:
    """Items (seq, url, title, article_text, summary_ru, trust_score) with summaries of those that lack one.

    model(rows) gives (id, summary) for rows (id, title, text), the summary_batch: any backend over a DataFrame.
    """
    rows = summary_batch(items, fetched, most, least_trust).drop("mode")
    return merged_summaries(items.withColumn("id", F.col("seq")), model(rows), least).drop("id")
