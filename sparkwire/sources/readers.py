"""Readers. What the network brings lies in a landing folder; these read it by explicit schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwire.functions.text import digest_items, html_to_text, is_block_page, nz, text, trim
from sparkwire.functions.urls import host
from sparkwire.operators.windows import first_wins, host_cap, top_per_key, until_breaker
from sparkwire.session import spread

from . import office
from .listing import Links
from .schemas import SCHEMAS

RSS_TOP, DIRECT_TOP = 25, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def feed_list(spark: SparkSession, path_: str) -> DataFrame:
    """One address a line; blank lines and comments are left out."""
    return spark.read.text(path_).select(F.trim("value").alias("feed")).where("feed <> '' and not startswith(feed, '#')")


def _positions(rows: DataFrame, top: int, order: list[str]) -> DataFrame:
    return top_per_key(rows, ["feed"], top, *[F.col(c) for c in order]).withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy(*order)))


def rss(spark: SparkSession, path_: str, top: int = RSS_TOP, snippet: bool = True) -> DataFrame:
    """Items of RSS files, the first `top` of each file in its order."""
    schema = "title string, link string, pubDate string, source string, description string"
    raw = spark.read.schema(schema).option("rowTag", "item").format("xml").load(path_)
    rows = raw.select(F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("at"), *[trim(text(F.col(c))).alias(c) for c in ("title", "link", "pubDate", "source", "description")])
    own = _positions(rows, top, ["at"])
    return own.select("feed", "pos", "title", F.col("link").alias("url"), "source", F.col("pubDate").alias("pub"), (F.col("description") if snippet else F.lit("")).alias("snippet"))


def atom(spark: SparkSession, path_: str, top: int = DIRECT_TOP) -> DataFrame:
    """Entries of Atom files."""
    schema = "title string, link array<struct<_href: string, _rel: string>>, updated string, summary string"
    raw = spark.read.schema(schema).option("rowTag", "entry").format("xml").load(path_)
    link = F.coalesce(F.try_element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"], F.lit(""))
    rows = raw.select(F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("at"), trim(text(F.col("title"))).alias("title"), link.alias("url"), F.lit("").alias("source"), text(F.col("updated")).alias("pub"), trim(text(F.col("summary"))).alias("snippet"))
    return _positions(rows, top, ["at"]).select("feed", "pos", "title", "url", "source", "pub", "snippet")


def direct(spark: SparkSession, path_: str, top: int = DIRECT_TOP) -> DataFrame:
    """RSS items, or Atom entries where a file has no items."""
    items = rss(spark, path_, top)
    entries = atom(spark, path_, top).join(items.select("feed").distinct(), "feed", "left_anti")
    return items.unionByName(entries)


def search_hits(responses: DataFrame, per_host: int = 2, most: int = 10) -> DataFrame:
    """Hits of a meta-search (query, seq, body JSON): no links into search engines, two of a host, the first `most`."""
    rows = responses.select("query", "seq", F.posexplode(F.from_json("body", "results array<struct<url: string, title: string>>")["results"]).alias("pos", "r"))
    url = F.col("r.url")
    rows = rows.select("query", "seq", "pos", url.alias("url")).where(url.rlike("^https?://"))
    h = host(F.col("url"))
    rows = rows.where(~h.contains("yandex.") & ~h.contains("google.") & ~F.col("url").contains("/clck/")).withColumn("host", h)
    return host_cap(rows, "host", per_host, most, ["query"], "pos")


def guarded(responses: DataFrame, limit: int = 25, budget_s: float = 360.0, narrow: int = 5, wide: int = 10) -> DataFrame:
    """Responses in order until the time is spent or after `limit` empty ones in a row; n_hits and elapsed_s are theirs.

    max_hits is how many hits each query may give: few for one that names a site.
    """
    most = F.when(F.lower(text(F.col("query"))).contains("site:"), narrow).otherwise(wide) if "query" in responses.columns else F.lit(wide)
    return until_breaker(responses.where(F.col("elapsed_s") <= budget_s), F.col("n_hits") == 0, limit).withColumn("max_hits", most)


#: Last parts of addresses that are no articles.
LISTING_TAIL = r"(?i)/(category|tag|page|search|login|about|contact|privacy|terms|sitemap|rss|feed)/?$"


def listing_links(pages: DataFrame, most: int = 15, url: str = "url", html: str = "html", selectors: dict[str, str | list[str]] | None = None) -> DataFrame:
    """(url, pos, href, label): article links of listing pages, of the page's own site.

    selectors: for a part of a host, a CSS selector of its links, or patterns of which an href must match
    one; the first part that the host contains counts, hosts without one take all links. Labels are the
    whole text of a link, tags within it or not; listing.SELECTORS has known sites.
    """
    base = F.regexp_replace(host(F.col(url)), r"www\.", "")
    selector, fits = F.lit("a"), F.lit(True)
    for part, wanted in reversed((selectors or {}).items()):
        of = F.col("base").contains(part)
        css = isinstance(wanted, str)
        selector = F.when(of, F.lit(wanted if css else "a")).otherwise(selector)
        fits = F.when(of, F.lit(True) if css else F.col("href").rlike("|".join(f"(?:{p})" for p in wanted))).otherwise(fits)
    own = pages.select(F.col(url).alias("page"), base.alias("base"), F.col(html).alias("html")).withColumn("selector", selector)
    rows = own.lateralJoin(Links(F.col("html").outer(), F.col("selector").outer())).select("page", "base", "pos", F.trim("link").alias("link"), "label")
    root, scheme = F.regexp_extract("page", r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract("page", r"^([A-Za-z]+:)", 1)
    href = F.when(F.col("link").startswith("//"), F.concat(scheme, "link")).when(F.col("link").startswith("/"), F.concat(root, "link")).otherwise(F.col("link"))
    rows = rows.select("page", "base", "pos", href.alias("href"), "label").where(F.col("href").startswith("http") & (F.length("label") >= 15)).where(fits)
    rows = rows.where(F.contains(F.regexp_replace(host(F.col("href")), r"www\.", ""), F.col("base")) & ~F.col("href").rlike(LISTING_TAIL))
    return top_per_key(first_wins(rows, F.struct("page", "href"), "pos"), ["page"], most, F.col("pos")).select(F.col("page").alias("url"), "pos", "href", "label")


def candidates(spark: SparkSession, path_: str) -> DataFrame:
    """A candidate file: a bare list, or an object with candidates, items or urls."""
    kind = "array<struct<title_en: string, url: string, source: string, query: string, pub: string, article_text: string, trust_score: double, trust_matched_domain: string, case_type: string>>"
    raw = spark.read.option("wholetext", True).text(path_)
    bare = F.from_json("value", kind)
    of = F.from_json("value", f"candidates {kind}, items {kind}, urls {kind}")
    rows = raw.select(F.posexplode(F.coalesce(F.when(F.ltrim("value").startswith("["), bare), of["candidates"], of["items"], of["urls"])).alias("seq", "c"))
    return rows.select(F.col("seq").cast("long").alias("seq"), "c.*")


def archive(spark: SparkSession, path_: str, name: str = "archive") -> DataFrame:
    """A stored archive; one that was never written is empty."""
    from .schemas import empty
    from .sinks import current

    where = current(spark, path_)
    return empty(spark, name) if where is None else spark.read.schema(SCHEMAS[name]).parquet(where)


def digest_runs(spark: SparkSession, path_: str) -> DataFrame:
    """(seq, run_ms, items) of a log of JSON lines; broken lines and such without news are left out."""
    raw = spark.read.text(path_).select(F.monotonically_increasing_id().alias("seq"), F.from_json("value", "summary string, runAtMs long, ts long").alias("d"))
    ms = F.coalesce(F.when(F.col("d.runAtMs") != 0, F.col("d.runAtMs")), F.col("d.ts"), F.lit(0).cast("long"))
    return raw.where(F.contains(F.col("d.summary"), F.lit("📰"))).select("seq", ms.alias("run_ms"), digest_items(F.col("d.summary")).alias("items")).where(F.size("items") > 0)


def files(spark: SparkSession, path_: str) -> DataFrame:
    """(path, ext, content): text of txt and md files by Spark, of others by the readers that are installed."""
    raw = spark.read.format("binaryFile").load(path_)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    plain = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    return raw.select("path", ext.alias("ext"), F.when(ext.isin("txt", "md"), plain).alias("content"), (~ext.isin("txt", "md")).alias("needs_reader"))


def document_files(spark: SparkSession, path_: str, extract=office.extract) -> DataFrame:
    """(path, ext, content, reason) of other files, DOCX and PDF by default; reason tells why a file has no content.

    Spark reads the files, from any store; extract(bytes, ext) -> text, or (text, reason), sees one at a time.
    """
    raw = spark.read.format("binaryFile").load(path_).select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "content")

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                got = extract(one["content"][0].as_py(), one["ext"][0].as_py())
                text_, reason = got if isinstance(got, tuple) else (got, None)
                yield pa.RecordBatch.from_arrays([one["path"], one["ext"], pa.array([text_], pa.string()), pa.array([reason], pa.string())], ["path", "ext", "content", "reason"])

    return raw.mapInArrow(run, "path string, ext string, content string, reason string")


def fetched_pages(rows: DataFrame) -> DataFrame:
    """(url, title, content) of fetched pages (url, html, fallback): short or blocked ones take the fallback if that is long enough."""
    body = html_to_text(F.col("html"))
    own = F.when(is_block_page(F.left(body, F.lit(600))), "").otherwise(body)
    other = F.when(F.length(text(F.col("fallback"))) >= 200, F.col("fallback"))
    content = F.when(F.length(own) >= 400, own).otherwise(F.coalesce(other, own))
    title = trim(F.regexp_extract(text(F.col("html")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    first = F.regexp_extract(content, r"^([^\n]*)", 1)
    line = F.when((F.length(first) > 10) & (F.length(first) < 300), first)
    return rows.where(F.col("url").rlike("^https?://")).select("url", F.left(F.coalesce(nz(title), line, F.col("url")), F.lit(300)).alias("title"), content.alias("content"))


def lookup(df: DataFrame, **equal) -> DataFrame:
    """Rows of the given keys whose text is not blank: point reads of caches."""
    cond: Column = F.lit(True)
    for k, v in equal.items():
        cond = cond & (F.col(k) == v)
    return df.where(cond & (trim(text(F.col("text"))) != ""))
