"""Knowledge-base documents: visibility, listing, changes, enrichment; and the checks on a run's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.functions.text import clean_tags, cut_bytes, has, inline_urls, is_block_page, nz, text, trim, upload_tags, without_antibot
from sparkwire.functions.urls import host


def can(users: DataFrame) -> DataFrame:
    """can_read, can_upload and can_moderate of users (is_admin, sections, moderator): who reads may upload."""
    read = F.coalesce(F.col("is_admin") | F.array_contains("sections", "kb"), F.lit(False))
    return users.withColumns({"can_read": read, "can_upload": read, "can_moderate": F.coalesce(F.col("is_admin") | F.col("moderator"), F.lit(False))})


def visible(user: str, moderator: bool) -> Column:
    own = (F.coalesce(nz(F.col("moderation_status")), F.lit("approved")) == "approved") | (F.col("author") == user)
    return F.lit(True) if moderator else F.coalesce(own, F.lit(False))


def listing(docs: DataFrame, user: str, moderator: bool, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = docs.where(visible(user, moderator))
    pending = F.when(F.col("moderation_status") == "pending", 0).otherwise(1)
    return rows.orderBy(pending, F.desc("created_at"), "id").offset(max(0, offset)).limit(max(1, min(200, limit)))


def presented(docs: DataFrame) -> DataFrame:
    """Rows as they are shown: blanks filled, tags as arrays."""
    split = lambda c: F.filter(F.transform(F.split(text(F.col(c)), ","), trim), lambda t: t != "")
    return docs.withColumns({"tags": split("tags"), "auto_tags": split("auto_tags"), "enrichment_status": F.coalesce(nz(F.col("enrichment_status")), F.lit("done")), "moderation_status": F.coalesce(nz(F.col("moderation_status")), F.lit("approved"))})


def inserted(new: DataFrame, at: str, most_bytes: int = 5 << 20) -> DataFrame:
    """New documents (title, content, author, is_moderator, ...) as rows; ids are hashes of their content."""
    first = F.regexp_extract(trim(text(F.col("content"))), r"^([^\n]*)", 1)
    title = F.left(F.coalesce(nz(trim(F.col("title"))), nz(first), F.lit("Без названия")), F.lit(300))
    ident = F.left(F.sha2(F.concat_ws("\n", text(F.col("author")), text(F.col("title")), text(F.col("content"))), 256), F.lit(16))
    status = F.when(F.col("is_moderator"), "approved").otherwise("pending")
    return new.withColumns({"id": ident, "title": title, "content": cut_bytes(text(F.col("content")), most_bytes), "moderation_status": status, "created_at": F.lit(at), "updated_at": F.lit(at)}).drop("is_moderator")


def approved(docs: DataFrame, ids: DataFrame, by: str, at: str) -> DataFrame:
    own = docs.join(ids.select("id").distinct().withColumn("__a", F.lit(True)), "id", "left")
    now = F.col("__a") & (F.coalesce("moderation_status", F.lit("")) != "approved")
    return own.withColumns({"approved_by": F.when(now, by).otherwise(F.col("approved_by")), "approved_at": F.when(now, at).otherwise(F.col("approved_at")), "moderation_status": F.when(now, "approved").otherwise(F.col("moderation_status"))}).drop("__a")


def deleted(docs: DataFrame, evidence: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id")
    return docs.join(gone, "id", "left_anti"), evidence.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def enriched(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents with the model's fields from replies (id, tldr, summary_md, tags csv, error)."""
    got = replies.select("id", F.left(trim(text(F.col("tldr"))), F.lit(500)).alias("__tldr"), F.left(trim(text(F.col("summary_md"))), F.lit(20_000)).alias("__summary"), clean_tags(F.col("tags")).alias("__tags"), nz(F.col("error")).alias("__error"), F.lit(True).alias("__got"))
    own = docs.join(got, "id", "left")
    fine = F.col("__got") & F.col("__error").isNull()
    pick = lambda new, old: F.when(fine, F.col(new)).otherwise(F.col(old))
    state = F.when(fine, "done").when(F.col("__got"), "error").otherwise(F.col("enrichment_status"))
    return own.withColumns({"tldr": pick("__tldr", "tldr"), "summary": pick("__summary", "summary"), "auto_tags": pick("__tags", "auto_tags"), "enrichment_error": F.when(F.col("__got"), F.coalesce("__error", F.lit(""))).otherwise(F.col("enrichment_error")), "enrichment_status": state}).select(docs.columns)


def search_tags(docs: DataFrame) -> DataFrame:
    return docs.withColumn("search_tags", F.array_join(F.filter(F.array(nz(F.col("tags")), nz(F.col("auto_tags"))), lambda t: t.isNotNull()), ","))


def fetched(candidates: DataFrame, tiers: list[tuple], trust: str = "trust_score", paid: tuple[str, float] | None = ("paid", 0.5), unchecked: tuple[str, ...] = ("snippets",)) -> DataFrame:
    """(text, mode) of the first tier (column, mode, least length) that is long enough and no block page; a paid tier needs trust.

    A tier with a fourth value wins only below that trust: PREFETCH has such a one. Tiers whose column is
    not there are passed over, and columns in `unchecked` hold texts that no site has sent.
    """
    out, mode = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column, name, least, *below in tiers:
        if column not in candidates.columns:
            continue
        fits = F.length(trim(text(F.col(column)))) >= least
        if column not in unchecked:
            fits = fits & ~is_block_page(F.col(column))
        if below:
            fits = fits & (F.coalesce(F.col(trust), F.lit(0.0)) < below[0])
        if paid and column == paid[0]:
            fits = fits & (F.coalesce(F.col(trust), F.lit(0.0)) >= paid[1])
        out, mode = F.coalesce(out, F.when(fits, F.col(column))), F.coalesce(mode, F.when(fits, F.lit(name)))
    return candidates.withColumn("text", F.coalesce(out, F.lit(""))).withColumn("mode", F.coalesce(mode, F.lit("thin")))


#: The tiers of a prefetch (columns direct, page, plain, snippets, paid): long snippets win, shorter ones below a trust of 0.5 or last.
PREFETCH = [("direct", "direct", 200), ("page", "page", 200), ("plain", "plain", 200), ("snippets", "snippets", 800), ("snippets", "snippets", 200, 0.5), ("paid", "paid", 200), ("snippets", "snippets", 200)]
#: What follows where those gave less than is needed for a summary: an agent that reads the page.
AGENT = [("agent", "agent", 300)]


def routed(rows: DataFrame, proxied_hosts: str, cut: int = 2500, least: int = 200) -> DataFrame:
    """rows (url, extracted, proxied, plain) with fetched_text and its tier: the order in which an article is read.

    The extractor's text comes first if it has `least` characters and no check for robots; else a host that
    matches proxied_hosts is read through the proxy, and any other plainly. A row without a url has no text.
    """
    best = nz(without_antibot(F.when(F.length("extracted") >= least, F.col("extracted"))))
    other = F.when(has(host(F.col("url")), proxied_hosts), F.struct(F.lit("proxied").alias("tier"), without_antibot(text(F.col("proxied"))).alias("t")))
    other = other.otherwise(F.struct(F.lit("plain").alias("tier"), without_antibot(text(F.col("plain"))).alias("t")))
    pick = F.when(nz(F.col("url")).isNull(), F.struct(F.lit("none").alias("tier"), F.lit("").alias("t")))
    pick = pick.when(best.isNotNull(), F.struct(F.lit("extracted").alias("tier"), best.alias("t"))).otherwise(other)
    return rows.withColumns({"tier": pick["tier"], "fetched_text": F.left(pick["t"], F.lit(cut))})


def rescued(candidates: DataFrame, least: int = 300) -> DataFrame:
    """(text, mode) by PREFETCH, then by AGENT where that is thin or short of `least`; what stays short has no text."""
    first = fetched(candidates, PREFETCH).withColumnsRenamed({"text": "__text", "mode": "__mode"})
    short = F.length("__text") < least
    both = fetched(first, AGENT)
    failed = F.concat_ws("->", "__mode", "mode") if "agent" in candidates.columns else F.col("__mode")
    mode = F.when(~short, F.col("__mode")).when(F.col("text") != "", F.col("mode")).otherwise(failed)
    return both.withColumns({"text": F.when(short, F.col("text")).otherwise(F.col("__text")), "mode": mode}).drop("__text", "__mode")


def modes(rows: DataFrame) -> DataFrame:
    """How often each mode of fetching was the one."""
    return rows.groupBy("mode").agg(F.count("*").alias("n"))


def with_linked(docs: DataFrame, pages: DataFrame, most: int = 40_000) -> DataFrame:
    """Documents with the texts of pages (url, text) that they name in line, in their order, within so many characters."""
    named = docs.select("id", F.posexplode(inline_urls(F.col("content"))).alias("p", "url"))
    got = named.join(pages.where(trim(text(F.col("text"))) != "").select("url", "text"), "url")
    parts = got.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "url", "text"))), lambda x: F.concat(x["url"], F.lit("\n"), x["text"])).alias("__parts"))
    own = docs.join(parts, "id", "left")
    return own.withColumn("content", F.left(F.concat_ws("\n\n", "content", "__parts"), F.lit(most))).drop("__parts")


def again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents to be enriched again: those asked for that are not pending, with their status so."""
    own = docs.join(ids.select("id").distinct().withColumn("__a", F.lit(True)), "id", "left")
    now = F.col("__a") & (F.coalesce(nz(F.col("moderation_status")), F.lit("approved")) != "pending")
    return own.withColumn("enrichment_status", F.when(now, "pending").otherwise(F.col("enrichment_status"))).drop("__a")


def uploaded(files: DataFrame, author: str, at: str, tags: str = "") -> DataFrame:
    """Files (path, ext, content) as approved documents of their author."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.where(F.col("content").isNotNull()).select(name.alias("title"), "content", F.lit("file").alias("source_type"), F.col("path").alias("source_ref"), F.col("ext").alias("file_ext"), upload_tags(F.lit(tags)).alias("tags"), F.lit(author).alias("author"), F.lit(True).alias("is_moderator"))
    return inserted(rows, at)


def merged_summaries(items: DataFrame, summaries: DataFrame, least: int = 200) -> DataFrame:
    """Items with summaries (id, summary) of at least so many characters."""
    good = summaries.where(F.length(trim(text(F.col("summary")))) >= least).select("id", trim(F.col("summary")).alias("__s"))
    return items.join(good, "id", "left").withColumn("summary_ru", F.coalesce("__s", "summary_ru")).drop("__s")


def watchdog(items: DataFrame, updated_at: str, as_of: str, summary: str = "summary_ru", hours: int = 20, fraction: float = 0.5, least: int = 3) -> DataFrame:
    """One row: count, blank share, age in hours, and what is to be warned of."""
    blank = F.count_if(trim(text(F.col(summary))) == "")
    row = items.agg(F.count("*").alias("total"), blank.alias("empty"))
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.try_to_timestamp(F.lit(updated_at)))) / 3600
    share = F.coalesce(F.try_divide(F.col("empty"), F.col("total")), F.lit(0.0))
    stale = (F.col("total") == 0) | F.coalesce(age > hours, F.lit(True))
    return row.select("total", "empty", F.round(share, 4).alias("empty_share"), F.round(age, 4).alias("age_hours"), stale.alias("stale"), ((share >= fraction) & (F.col("total") >= least)).alias("many_empty"))


def evening(items: DataFrame, today: str, baseline: int, collected: str = "collected_at") -> DataFrame:
    now = F.count_if(F.left(F.col(collected), F.lit(10)) == today)
    return items.agg(now.alias("today"), (now - baseline).alias("increment"), F.count("*").alias("total"))


def latest_health(runs: DataFrame) -> DataFrame:
    """The latest run of each mode."""
    cols = [c for c in runs.columns if c != "mode"]
    return runs.groupBy("mode").agg(F.max_by(F.struct(*cols), "finished_at").alias("r")).select("mode", "r.*")
