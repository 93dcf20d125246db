"""Merges into the candidate list and the archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwire.functions.text import nz, text
from sparkwire.functions.urls import hash_url_title, channel, normalize
from sparkwire.session import checkpoint

from .dedupe import REF, attach, collapse, leaders, story_groups
from .windows import first_wins, last_wins, numbered

MOST, CUT = 200, 800


def merge_candidates(existing: DataFrame, new: DataFrame, most: int = MOST, cut: int = CUT) -> DataFrame:
    """Existing rows and the new ones of other URLs, by trust and length of text, the first `most`, texts cut afterwards.

    Both need seq, url, article_text, trust_score; new rows come after existing ones at ties.
    """
    key = normalize(F.col("url"))
    fresh = first_wins(new.withColumn("__url", key), "__url").join(existing.select(key.alias("__url")).distinct(), "__url", "left_anti").drop("__url")
    both = existing.withColumn("__part", F.lit(0)).unionByName(fresh.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    order = [F.desc(F.coalesce("trust_score", F.lit(0.0))), F.desc(F.length(text(F.col("article_text")))), "__part", "seq"]
    return both.orderBy(*order).limit(most).withColumn("article_text", F.left("article_text", F.lit(cut))).drop("__part")


UPDATABLE = ("summary_ru", "relevance_score", "relevance_reason", "trust_origin", "is_event_news", "bank_applicability", "bank_applicability_reason")


def fill_fields(archive: DataFrame, incoming: DataFrame, key: str, fields=UPDATABLE, order: str = "seq") -> DataFrame:
    """The archive with fields that were null or empty taken from the first incoming row of the same key that has them."""
    fields = [f for f in fields if f in archive.columns and f in incoming.columns]
    if not fields:
        return archive
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    first = incoming.groupBy(key).agg(*[F.min_by(F.when(~empty(f), F.col(f)), F.when(~empty(f), F.col(order))).alias(f"__{f}") for f in fields])
    out = archive.join(first, key, "left")
    return out.withColumns({f: F.when(empty(f), F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def upsert(archive: DataFrame, incoming: DataFrame, as_of: str, title: str = "title", keep_dups: bool = True, attach_dups: bool = True, last: int | None = None, collapsed: bool = False) -> DataFrame:
    """The archive after a batch: collapse it, fill its fields, collapse story groups, then add what is new.

    An incoming row of a known hash adds its dup_sources to the archive's row; a near-duplicate of an
    archive row, or of a row added before it, is attached (or dropped); the others are added. With
    keep_dups=False an added row loses the dup_sources of its story group. last is the last seq given out,
    where archive is not the whole; collapsed, that archive is known to have no near-duplicates.
    """
    old = archive if collapsed else collapse(archive, title)
    if "story_group" in incoming.columns:
        grouped = story_groups(incoming, title=title)
        incoming = fill = grouped.withColumn("__o", F.struct(F.when(F.col("story_group").isNull(), 0).otherwise(1), F.col("seq")))
        old = fill_fields(old, fill, "article_hash")
    else:
        old = fill_fields(old, incoming, "article_hash")
        incoming = incoming.withColumn("__o", F.struct(F.lit(0), F.col("seq")))
    if "dup_sources" not in incoming.columns:
        incoming = incoming.withColumn("dup_sources", F.array().cast(REF))
    incoming = incoming.withColumn("collected_at", F.coalesce(nz(F.col("collected_at")), F.lit(as_of)))
    old = checkpoint(old)
    known = incoming.join(old.select("article_hash"), "article_hash", "left_semi")
    named = old.select(F.col("article_hash").alias("__h"), F.col("seq").alias("__s"))
    more = known.where(F.size("dup_sources") > 0).join(named, F.col("article_hash") == F.col("__h")).select(F.col("__s"), "__o", "dup_sources")
    listed = more.select("__s", "__o", F.posexplode("dup_sources").alias("__p", "ref")).groupBy("__s").agg(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__p", "ref"))), lambda x: x["ref"]).alias("__more"))
    old = old.join(listed, old.seq == listed["__s"], "left").drop("__s")
    merged = F.concat(F.coalesce("dup_sources", F.array().cast(REF)), F.coalesce("__more", F.array().cast(REF)))
    old = old.withColumn("dup_sources", _distinct_urls(merged)).drop("__more")
    usable = (nz(F.col("article_hash")).isNotNull()) & (nz(F.col("url")).isNotNull()) & (nz(F.col(title)).isNotNull())
    fresh = first_wins(incoming.where(usable), "article_hash", "__o").join(old.select("article_hash"), "article_hash", "left_anti")
    if not keep_dups:
        fresh = fresh.withColumn("dup_sources", F.array().cast(REF))
    placed = old.withColumn("__key", F.struct(F.lit(0), F.struct(F.lit(0), F.col("seq")))).withColumn("__old", F.lit(True))
    both = checkpoint(placed.unionByName(fresh.withColumn("__key", F.struct(F.lit(1), F.col("__o"))).withColumn("__old", F.lit(False)).drop("__o"), allowMissingColumns=True))
    lead = leaders(both, title, "__key", decided=F.col("__old"))
    joined = checkpoint(both.join(lead, both["__key"] == lead["pos"]).drop("pos"))
    kept, gone = joined.where("leader is null"), joined.where("leader is not null")
    if attach_dups:
        kept = attach(kept, gone, "__key", "leader", title, "__key")
    base = kept.where("__old").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if last is None else last
    added = numbered(kept.where("not __old"), "__key", "seq", base)
    return kept.where("__old").unionByName(added).select([c for c in kept.columns if c not in ("__key", "__old", "leader", "story_group")])


def _distinct_urls(refs):
    """References of one row, the first of each URL: a row's own list, folded in order."""
    return F.aggregate(refs, F.array().cast(REF), lambda acc, r: F.when((text(r["url"]) == "") | F.exists(acc, lambda x: x["url"] == r["url"]), acc).otherwise(F.concat(acc, F.array(r))))


def packages(archive: DataFrame, runs: DataFrame, as_of_ms: int, days: int = 7) -> DataFrame:
    """The archive of digest items after runs (seq, run_ms, items of digest_items): near-duplicates are dropped."""
    recent = runs.where(F.col("run_ms") >= as_of_ms - days * 86_400_000).select("seq", "run_ms", F.posexplode("items").alias("p", "item"))
    rows = recent.select(F.struct("seq", "p").alias("o"), "item.*", F.date_format(F.timestamp_millis("run_ms"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("collected_at"))
    rows = rows.join(archive.select("url", "title").distinct(), ["url", "title"], "left_anti")
    rows = first_wins(rows, F.struct("url", "title"), "o")
    items = numbered(rows, "o", "seq").select("seq", hash_url_title(F.col("url"), F.col("title")).alias("article_hash"), "title", "url", channel(F.col("url")).alias("source"), "posted_at", "collected_at", F.lit(None).cast("double").alias("trust_score"))
    return upsert(archive, items, "", attach_dups=False)


def upsert_rows(old: DataFrame, new: DataFrame, key: str, order: str = "seq", replace: bool = True) -> DataFrame:
    """Insert or replace (the last row of a key wins) or insert or ignore (the first wins)."""
    both = old.withColumn("__part", F.lit(0)).unionByName(new.withColumn("__part", F.lit(1)), allowMissingColumns=True).withColumn("__o", F.struct("__part", F.col(order)))
    return (last_wins if replace else first_wins)(both, key, "__o").drop("__part", "__o")


def unexpired(cache: DataFrame, as_of: str, hours: int, ts: str = "ts") -> DataFrame:
    return cache.where(F.col(ts) > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(hours)))
