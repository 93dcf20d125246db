"""The operators over the driver's tables, each with SQL that gives the same rows.

The tables carry no news, so that operators run on columns of the same kind: pages as links, documents
as articles, orders as hypotheses with lineitems as evidence, events as jobs and reader events. Every
query takes whole tables. A limit stands only where the operator is one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions import scores, text, urls
from sparkwire.operators import archive, dedupe, documents, insights, jobs, kept, search, state, windows
from sparkwire.session import checkpoint, shared_folder
from sparkwire.sources import schemas
from sparkwire.sources.readers import table
from sparkwire.streaming import incremental

REGISTRY = [("example.com", 0.85), ("example.net", 0.5), ("example.org", 0.3), ("spam-farm.example.org", 0.15), ("cheap-pills.example.com", 0.15)]
TRAVEL, AI, BANKING = r"\b(the|que|der)\b", r"\b(of|enan|zu)\b", r"\b(and|un|und|los)\b"
SHAPES = {
    "bad_host": r"^spam-farm\.", "news_hosts": ["www.cheap-pills.example.com", "cheap-pills.example.com"], "news_path": r"/(en|fr)/", "bank_hosts": ["www.cheap-pills.example.com"],
    "bank_news_path": r"/en/\d+", "whitelist": r"/en/\d{3}", "landing": r"^/[a-z]{2}/\d$", "bad_path": r"/(de)(/|$)", "product": r"/es/\d+\.html",
}
AS_OF = "2024-01-31T00:00:00"
# SQL of a word boundary, of a host, of a path and of the tokens of a title
_B = r"(^|[^\p{L}\p{N}_])({})([^\p{L}\p{N}_]|$)"
_HOST = r"lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':\d*$', ''))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in P.TITLE_STOP) + "]"
_TOKENS = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({{}}, '{P.TITLE_WORD}'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))))"
_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "domain string, score double")


def _titled(spark, sf_dir) -> DataFrame:
    """Pages as articles of one moment, in order of page_id."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), text.page_title(F.col("html")).alias("title"), "url", urls.host(F.col("url")).alias("source"))
    return urls.with_trust(pages, "url", _registry(spark)).withColumn("collected_at", F.lit(AS_OF))


def _classified(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.classify(F.lit(""), F.col("text"), TRAVEL, AI, BANKING).alias("topic"))


_CLASSIFIED = f"""SELECT doc_id, CASE WHEN NOT regexp_matches(b, '{_B.replace('{}', 'the|que|der', 1)}', 'i') THEN 'NONE'
  WHEN regexp_matches(b, '{_B.replace('{}', 'of|enan|zu', 1)}', 'i') AND regexp_matches(b, '{_B.replace('{}', 'and|un|und|los', 1)}', 'i') THEN '{P.AI_BANK_TRAVEL}'
  WHEN regexp_matches(b, '{_B.replace('{}', 'of|enan|zu', 1)}', 'i') THEN '{P.AI_TRAVEL}'
  WHEN regexp_matches(b, '{_B.replace('{}', 'and|un|und|los', 1)}', 'i') THEN '{P.BANK_TRAVEL}' ELSE 'NONE' END AS topic
  FROM (SELECT doc_id, ' ' || left(text, 1500) AS b FROM documents)"""

_SUFFIX = " UNION ALL ".join(f"SELECT '{d}' AS domain, {s} AS score" for d, s in REGISTRY)
_TRUST = rf"""SELECT page_id, url, coalesce(h.score, 0.10) AS trust_score, coalesce(h.domain, '') AS trust_matched_domain FROM
  (SELECT page_id, url, regexp_replace({_HOST}, '^(?:www\.)?(?:m\.)?(?:mobile\.)?(?:amp\.)?(?:ru\.)?(?:en\.)?', '') AS d FROM pages) p
  LEFT JOIN LATERAL (SELECT r.score, r.domain FROM ({_SUFFIX}) r WHERE p.d = r.domain OR ends_with(p.d, '.' || r.domain) ORDER BY length(r.domain) DESC LIMIT 1) h ON true"""
_NORM = rf"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || {_PATH} ||
  CASE WHEN len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT starts_with(x, 'utm_') AND regexp_matches(x, '^[^=]*=.+'))) > 0
  THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT starts_with(x, 'utm_') AND regexp_matches(x, '^[^=]*=.+')), '&') ELSE '' END"""
_SHAPE = rf"""CASE WHEN regexp_matches(h, '^spam-farm\.') THEN 'bad_host' WHEN p IN ('', '/') THEN 'root'
  WHEN h IN ('www.cheap-pills.example.com', 'cheap-pills.example.com') AND NOT regexp_matches(p, '/(en|fr)/') THEN 'no_news_path'
  WHEN h = 'www.cheap-pills.example.com' AND NOT regexp_matches(p, '/en/[0-9]+') THEN 'no_bank_news_path'
  WHEN regexp_matches(p, '/en/[0-9]{{3}}') THEN 'whitelist' WHEN regexp_matches(p, '^/[a-z]{{2}}/[0-9]$') THEN 'landing'
  WHEN regexp_matches(p, '/(de)(/|$)') THEN 'bad_path' WHEN regexp_matches(p, '/es/[0-9]+\.html') THEN 'product' ELSE 'plain' END"""
_SHAPED = f"SELECT page_id, url, {_SHAPE} AS shape FROM (SELECT page_id, url, {_HOST} AS h, {_PATH} AS p FROM pages)"


def _shaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.shape(F.col("url"), **SHAPES).alias("shape"))


def _funnel(spark, sf_dir):
    rows = _shaped(spark, sf_dir).withColumn("norm", urls.normalize(F.col("url")))
    good = rows.withColumn("good", F.col("shape").isin(*urls.GOOD))
    first = good.where("good").groupBy("norm").agg(F.min("page_id").alias("first"))
    reason = F.when(~F.col("good"), "bad_shape").when(F.col("page_id") == F.col("first"), "stubbed").otherwise("deduped")
    return good.join(first, "norm", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def _links(spark, sf_dir):
    html = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.anchors(F.col("html"))).alias("pos", "a"))
    return html.select("page_id", F.col("pos").cast("long").alias("pos"), "a.href", "a.label")


def _html_sql() -> str:
    out = r"regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, plain in text.ENTITIES.items():
        entity, plain = entity.replace("'", "''"), plain.replace("'", "''")
        out = f"replace({out}, '{entity}', '{plain}')"
    out = rf"regexp_replace({out}, '[ \t\r\f\v]+', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\s*\n\s*', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return rf"SELECT page_id, regexp_replace({out}, '^\s+|\s+$', '', 'g') AS body FROM pages"


_SENT = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(b, E' \t\n\r'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')[1:2], ' ')"""
_SIGNALS = r"\b(the|of|que|der)\b"


def _rated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(_classified(spark, sf_dir), "doc_id")
    r = text.rate(F.lit(""), F.col("text"), F.col("topic"), _SIGNALS)
    return docs.select("doc_id", r.alias("r")).select("doc_id", "r.summary", F.col("r.rating").cast("long").alias("rating"), F.col("r.signals").cast("long").alias("signals"))


def _title_links(spark, sf_dir):
    return dedupe.links(_titled(spark, sf_dir).withColumnRenamed("seq", "page_id"), "title", "page_id")


_TITLE_SQL = f"t AS (SELECT page_id, {_TOKENS.format(_TITLE)} AS tok FROM pages), " + """
  e AS (SELECT x.page_id AS a, y.page_id AS b, len(list_intersect(x.tok, y.tok)) AS common, len(list_distinct(list_concat(x.tok, y.tok))) AS united
        FROM t x JOIN t y ON x.page_id < y.page_id AND len(x.tok) > 0 AND len(y.tok) > 0 WHERE 10 * len(list_intersect(x.tok, y.tok)) >= 7 * len(list_distinct(list_concat(x.tok, y.tok))))"""


def _collapsed(spark, sf_dir):
    out = dedupe.collapse(_titled(spark, sf_dir), "title", "seq")
    return out.select(F.col("seq").alias("page_id"), F.size("dup_sources").cast("long").alias("n_dups"), F.array_join(F.transform("dup_sources", lambda d: d["url"]), " ").alias("dups"))


_COLLAPSE_SQL = f"""WITH RECURSIVE {_TITLE_SQL},
  n AS (SELECT t.page_id, row_number() OVER (ORDER BY t.page_id) AS pos, coalesce(list(e.a ORDER BY e.a) FILTER (e.a IS NOT NULL), []) AS before FROM t LEFT JOIN e ON e.b = t.page_id GROUP BY t.page_id),
  s AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL
        SELECT n.pos, CASE WHEN len(list_intersect(s.kept, n.before)) > 0 THEN s.kept ELSE list_append(s.kept, n.page_id) END FROM s JOIN n ON n.pos = s.pos + 1),
  k AS (SELECT unnest(kept) AS page_id FROM (SELECT kept FROM s ORDER BY pos DESC LIMIT 1)),
  d AS (SELECT e.b, min(e.a) AS leader FROM e SEMI JOIN k ON e.a = k.page_id ANTI JOIN k AS kk ON e.b = kk.page_id GROUP BY e.b),
  r AS (SELECT d.leader, p.url, min(d.b) AS at FROM d JOIN pages p ON p.page_id = d.b JOIN pages l ON l.page_id = d.leader WHERE p.url <> l.url GROUP BY d.leader, p.url)
  SELECT k.page_id, count(r.url) AS n_dups, coalesce(string_agg(r.url, ' ' ORDER BY r.at), '') AS dups FROM k LEFT JOIN r ON r.leader = k.page_id GROUP BY k.page_id"""


def _kept_archive(spark, sf_dir):
    """Pages of even numbers as an archive, the others as a batch."""
    pages = _titled(spark, sf_dir).withColumns({"article_hash": F.concat(F.lit("h"), F.col("seq").cast("string")), "dup_sources": F.array().cast(dedupe.REF)})
    pages = checkpoint(pages.withColumn("page_id", F.col("seq")))
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    kept.create(pages.where("page_id % 2 = 0"), path)
    kept.apply(spark, path, pages.where("page_id % 2 = 1"), AS_OF)
    return kept.read(spark, path).select("page_id", F.size("dup_sources").cast("long").alias("n_dups"))


_KEPT_SQL = f"""WITH RECURSIVE o AS (SELECT page_id AS id, url AS link, html, row_number() OVER (ORDER BY page_id % 2, page_id) AS page_id FROM pages),
  {_TITLE_SQL.replace("FROM pages", "FROM o")},
  n AS (SELECT t.page_id, t.page_id AS pos, coalesce(list(e.a ORDER BY e.a) FILTER (e.a IS NOT NULL), []) AS before FROM t LEFT JOIN e ON e.b = t.page_id GROUP BY t.page_id),
  s AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL
        SELECT n.pos, CASE WHEN len(list_intersect(s.kept, n.before)) > 0 THEN s.kept ELSE list_append(s.kept, n.page_id) END FROM s JOIN n ON n.pos = s.pos + 1),
  k AS (SELECT unnest(kept) AS page_id FROM (SELECT kept FROM s ORDER BY pos DESC LIMIT 1)),
  d AS (SELECT e.b, min(e.a) AS leader FROM e SEMI JOIN k ON e.a = k.page_id ANTI JOIN k AS kk ON e.b = kk.page_id GROUP BY e.b),
  r AS (SELECT DISTINCT d.leader, p.link FROM d JOIN o p ON p.page_id = d.b JOIN o l ON l.page_id = d.leader WHERE p.link <> l.link)
  SELECT o.id AS page_id, count(r.link) AS n_dups FROM k JOIN o USING (page_id) LEFT JOIN r ON r.leader = k.page_id GROUP BY o.id"""


def _merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("http://"), "source", F.lit(".example/"), F.col("n_chars").cast("string")).alias("url"), F.col("text").alias("article_text"), ((F.col("n_chars") % 7) / 10.0).alias("trust_score"), "lang")
    out = archive.merge_candidates(docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang"))
    return out.select(F.col("seq").alias("doc_id"), "url", F.length("article_text").cast("long").alias("kept"), F.round("trust_score", 2).alias("trust_score"))


_MERGE_SQL = """WITH d AS (SELECT doc_id, 'http://' || source || '.example/' || n_chars AS url, text, (n_chars % 7) / 10.0::DOUBLE AS trust, lang FROM documents),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS r FROM d WHERE lang <> 'en') WHERE r = 1 AND url NOT IN (SELECT url FROM d WHERE lang = 'en')),
  both_ AS (SELECT doc_id, url, text, trust, 0 AS part FROM d WHERE lang = 'en' UNION ALL SELECT doc_id, url, text, trust, 1 FROM fresh)
  SELECT doc_id, url, length(left(text, 800)) AS kept, round(trust, 2) AS trust_score FROM both_ ORDER BY trust DESC, length(text) DESC, part, doc_id LIMIT 200"""


def _filled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("relevance_reason"), F.lit("").alias("trust_origin"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("relevance_reason"), F.when(F.col("toxic") == 1, "toxic").alias("trust_origin"), F.col("doc_id").alias("seq"))
    return archive.fill_fields(docs, labels, "doc_id")


def _stories(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("seq"), F.col("text").alias("title"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), "source", F.col("q").cast("double").alias("trust_score"), F.lit(AS_OF).alias("collected_at"), F.when(F.col("lang") != "de", F.concat("source", "lang")).alias("story_group"))
    out = dedupe.story_groups(docs)
    return out.select(F.col("seq").alias("doc_id"), F.size("dup_sources").cast("long").alias("n_dups"), F.coalesce(F.try_element_at("dup_sources", F.lit(1))["url"], F.lit("")).alias("first_dup"))


_STORY_SQL = """WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
  d AS (SELECT d.doc_id, source, CASE WHEN lang <> 'de' THEN source || lang END AS g, coalesce(q, 0) AS q FROM documents d LEFT JOIN l USING (doc_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, doc_id) AS r, count(*) OVER (PARTITION BY g) AS n FROM d WHERE g IS NOT NULL),
  s AS (SELECT g, source || '/' || doc_id AS url FROM r WHERE r = 2)
  SELECT doc_id, 0 AS n_dups, '' AS first_dup FROM d WHERE g IS NULL UNION ALL
  SELECT r.doc_id, r.n - 1, coalesce(s.url, '') FROM r LEFT JOIN s ON r.g = s.g WHERE r.r = 1"""


def _evidence(spark, sf_dir):
    news = F.when(F.col("l_returnflag") == "A", F.lit("news:")).otherwise("")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hypothesis_id"), F.concat(news, F.col("l_partkey").cast("string")).alias("doc_id"))


def _hypotheses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "in_review").when(F.col("o_orderstatus") == "O", "validated").otherwise("synthesized")
    cat = F.when(F.col("o_orderpriority").startswith("1"), P.CATEGORIES[0]).when(F.col("o_orderpriority").startswith("2"), P.CATEGORIES[1]).otherwise(P.CATEGORIES[2])
    return o.select(
        F.col("o_orderkey").alias("id"), cat.alias("category"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("validated"), (F.col("o_totalprice") / 1000000).alias("confidence"), F.lit(7).cast("long").alias("evidence_count"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), status.alias("lifecycle_status"), F.concat(F.lit("User"), (F.col("o_custkey") % 10).cast("string")).alias("owner_username"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")), "yyyy-MM-dd").alias("next_check_at"), F.lit(None).cast("string").alias("source_kind"),
    )


_HYP = f"""h AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN '{P.CATEGORIES[0]}' WHEN o_orderpriority LIKE '2%' THEN '{P.CATEGORIES[1]}' ELSE '{P.CATEGORIES[2]}' END AS category,
  CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS validated, o_totalprice / 1000000 AS confidence, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'in_review' WHEN 'O' THEN 'validated' ELSE 'synthesized' END AS lifecycle_status, 'user' || (o_custkey % 10) AS owner,
  strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER), '%Y-%m-%d') AS next_check_at FROM orders),
  ev AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'news:' ELSE '' END || l_partkey AS doc_id FROM lineitem),
  n AS (SELECT id, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (starts_with(doc_id, 'news:')) AS nn FROM ev GROUP BY id),
  w AS (SELECT h.*, CASE WHEN coalesce(n.n, 0) > 0 THEN n.n ELSE 7 END AS n_evidence, CASE WHEN coalesce(n.n, 0) = 0 OR nn = 0 THEN 'material' WHEN nn = n.n THEN 'news' ELSE 'mixed' END AS kind FROM h LEFT JOIN n USING (id))"""
DAY = "1997-06-15"


def _mine(spark, sf_dir):
    rows = insights.mine(_hypotheses(spark, sf_dir), "user3", f"{DAY}T12:00:00", f"{DAY}T00:00:00")
    return rows.select("id", "overdue", "is_new", "next_check_at")


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    tier = F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "premium").otherwise("basic")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "queued").otherwise("done")
    started = F.when(F.col("event_type") != "signup", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 100).cast("decimal(18,6)")))
    ended = F.when(F.col("event_type") != "signup", started + F.make_dt_interval(secs=(F.col("event_id") % 977).cast("decimal(18,6)")))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), tier.alias("tier"), status.alias("status"), iso(F.col("ts")).alias("submitted_at"), iso(started).alias("started_at"), iso(ended).alias("finished_at"), scores.priority(tier, F.unix_millis(F.col("ts").cast("timestamp"))).alias("priority"))


_JOBS = """j AS (SELECT event_id, event_type AS kind, CASE user_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'premium' ELSE 'basic' END AS tier, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' ELSE 'done' END AS status, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'signup' THEN event_id % 100 END AS wait, CASE WHEN event_type <> 'signup' THEN event_id % 977 END AS run FROM events)"""
_PCT = "coalesce(list_sort(list({0}) FILTER ({1}))[1 + CAST(round_even((count(*) FILTER ({1}) - 1) * {2}, 0) AS BIGINT)], 0)"
_METRICS = f"""WITH {_JOBS}, g AS (SELECT 'kind' AS dimension, kind AS name, * FROM j UNION ALL SELECT 'tier', tier, * FROM j)
  SELECT dimension, name, count(*) AS "count", count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS errors, round_even(count(*) FILTER (status = 'error') / count(*), 3) AS error_rate,
  {_PCT.format('run', "status = 'done'", 0.5)} AS p50_duration_s, {_PCT.format('run', "status = 'done'", 0.95)} AS p95_duration_s, CAST(floor(coalesce(avg(run) FILTER (status = 'done'), 0)) AS BIGINT) AS avg_duration_s,
  {_PCT.format('wait', 'wait IS NOT NULL', 0.5)} AS p50_wait_s, {_PCT.format('wait', 'wait IS NOT NULL', 0.95)} AS p95_wait_s FROM g GROUP BY dimension, name"""


def _reader_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type").isin("purchase", "click"), "like").when(F.col("event_type") == "error", "dislike").when(F.col("event_type") == "signup", "clear")
    kind = F.when(F.col("event_type") == "view", "bookmark").otherwise("react")
    return e.select(F.struct("ts", "event_id").alias("seq"), (F.col("event_id") % 97).alias("article_hash"), F.col("user_id").alias("user"), kind.alias("kind"), value.alias("value"))


def _chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_hash"), F.lit("u").alias("user"), F.lit("chat").alias("kind"), F.col("text").alias("value"), F.col("turn").alias("seq"), "role")
    out = state.chats(c, "seq")
    return out.select(F.col("article_hash").alias("conv_id"), F.col("seq").alias("turn"), "role", F.length("value").cast("long").alias("n"))


def _breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    kept = windows.until_breaker(e, F.col("value") < 60, 3, "event_id", ["user_id"])
    return kept.groupBy("user_id").agg(F.count("*").alias("asked"), F.max("event_id").alias("last_event"))


def _fts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = search.search(docs, "doc_id", ["text", "lang"], "there on", 50, digits=6)
    return out.select(F.col("id").alias("doc_id"), "score")


_FTS = r"""WITH w AS (SELECT doc_id, list_concat(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿёй', 'aaaaaaceeeeiiiinoooooouuuuyyеи'), '[\p{L}\p{N}]+'), [lang]) AS w FROM documents),
  f AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: starts_with(x, 'there'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'on'))) AS b FROM w),
  s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
  SELECT doc_id, round(-(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score
  FROM f, s WHERE a > 0 AND b > 0 ORDER BY score, doc_id LIMIT 50"""


def _phrases(spark, sf_dir):
    postings, lengths = search.index(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"])
    out = search.search_index(postings, lengths, "of-the t the-o", 100, digits=6)
    return out.select(F.col("id").alias("doc_id"), "score")


_PHRASES = r"""WITH w AS (SELECT doc_id, list_concat(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿёй', 'aaaaaaceeeeiiiinoooooouuuuyyеи'), '[\p{L}\p{N}]+'), [NULL], [source]) AS w FROM documents),
  f AS (SELECT doc_id, len(w) - 1 AS dl, len(list_filter(w, lambda x, i: x = 'of' AND w[i + 1] = 'the' OR x = 'of' AND starts_with(w[i + 1], 'the'))) AS a,
        len(list_filter(w, lambda x: starts_with(x, 't'))) AS b, len(list_filter(w, lambda x, i: x = 'the' AND starts_with(w[i + 1], 'o'))) AS c FROM w),
  s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM f),
  x AS (SELECT doc_id, dl / m AS l, a, b, c, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) AS ia, greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) AS ib, greatest(1e-6, ln((n - dc + 0.5) / (dc + 0.5))) AS ic FROM f, s WHERE a > 0 AND b > 0 AND c > 0)
  SELECT doc_id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l)) + ic * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * l))), 6) AS score
  FROM x ORDER BY score, doc_id LIMIT 100"""


def _best(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("id"), text.page_title(F.col("html")).alias("statement"), F.lit("x").alias("category"))
    first = pages.groupBy("statement").agg(F.min("id").alias("id"))
    known = first.select("id", "statement", F.lit("x").alias("category"), F.col("id").alias("pos"))
    out = insights.best_match(pages, known)
    return out.select(F.col("id").alias("page_id"), F.col("match").alias("best"), F.col("common").cast("long").alias("common"), F.col("united").cast("long").alias("united"))


_BEST = f"""WITH d AS (SELECT page_id, {_TITLE} AS s FROM pages),
  k AS (SELECT min(page_id) AS id, s FROM d GROUP BY s), dt AS (SELECT page_id, {_TOKENS.format('s')} AS t FROM d), kt AS (SELECT id, {_TOKENS.format('s')} AS t FROM k),
  tok AS (SELECT DISTINCT t FROM dt WHERE len(t) > 0), x AS (SELECT a.t AS ta, b.t AS tb, len(list_intersect(a.t, b.t)) AS common, len(list_distinct(list_concat(a.t, b.t))) AS united FROM tok a JOIN tok b ON list_has_any(a.t, b.t)),
  p AS (SELECT dt.page_id, kt.id, common, united FROM x JOIN dt ON dt.t = x.ta JOIN kt ON kt.t = x.tb WHERE 10 * common >= 7 * united),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY common / united DESC, id) AS r FROM p)
  SELECT page_id, id AS best, common, united FROM r WHERE r = 1"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _rows(spark, sf_dir):
    """Documents as a knowledge base: those of some sources pending, authors by language."""
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("source").isin("src1", "src2", "src3"), "pending").otherwise("approved").alias("moderation_status"), F.col("lang").alias("author"), F.col("n_chars").alias("created_at"))


def _rss_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pub = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return e.where(scores.is_fresh(pub, F.to_timestamp(F.lit(AS_OF)))).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def _labels_docs(spark, sf_dir):
    docs, seen = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    return insights.unprocessed(docs.select(F.col("doc_id").alias("id"), "n_chars"), seen, [F.desc("n_chars"), F.col("id")], 60).select(F.col("id").alias("doc_id"), "n_chars")


def _latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return archive.upsert_rows(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def _links_graph(spark, sf_dir):
    return insights.graph(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hypothesis_id"), F.col("l_partkey").alias("doc_id")))


def _events_reply(spark, sf_dir):
    """An agent's raw reply for each event: noise, then JSON with a payload, a summary, or neither."""
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_type") == "error", F.lit("no json")).when(F.col("event_type") == "view", F.concat(F.lit('log {"summary": "s'), "user_id", F.lit('", "sessionId": "x'), "event_id", F.lit('"}')))
    raw = body.otherwise(F.concat(F.lit('log {"result": {"payloads": [{"text": " p'), "event_id", F.lit('"}, {"text": ""}, {"text": "[[reply_to_current]]q"}], "meta": {"agentMeta": {"sessionId": "y'), "user_id", F.lit('"}}}}')))
    return e.select("event_id", text.envelope(raw).alias("r")).select("event_id", "r.reply", "r.error", "r.session")


def _lifecycle(spark, sf_dir):
    h = _hypotheses(spark, sf_dir).select("id", "lifecycle_status", F.when(F.col("id") % 3 > 0, F.col("owner_username")).alias("owner_username"))
    to = F.when(F.col("id") % 4 == 0, "in_review").when(F.col("id") % 4 == 1, "validated").when(F.col("id") % 4 == 2, "archived").otherwise("adopted")
    events = h.select("id", to.alias("to"), F.lit("me").alias("caller"), (F.col("id") % 8 < 4).alias("confirm"))
    return state.checked(events, h).select("id", "result", "lifecycle_status", F.coalesce("owner_username", F.lit("")).alias("owner"))


def _tiers(spark, sf_dir):
    d = _docs(spark, sf_dir)
    rows = d.select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("direct"), F.when(F.col("lang") != "de", F.col("text")).alias("snippets"), F.col("text").alias("paid"), ((F.col("doc_id") % 10) / 10.0).alias("trust_score"))
    out = documents.fetched(rows, [("direct", "direct", 300), ("snippets", "snippets", 400), ("paid", "paid", 200), ("snippets", "snippets", 200)])
    return out.select("doc_id", "mode", F.length("text").cast("long").alias("n"))


def _snapshot(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("seq"), "url", text.page_title(F.col("html")).alias("title"), urls.host(F.col("url")).alias("source"), F.lit(AS_OF).alias("collected_at"), F.lit("").alias("summary_ru"), F.lit("").alias("case_type"))
    hashed = pages.withColumn("article_hash", F.when(F.col("seq") % 2 == 0, F.sha2("title", 256)))
    return insights.news_snapshot(hashed, pages).select("id", "origin", "url")


def _neighbours(spark, sf_dir):
    nodes = _hypotheses(spark, sf_dir).select("id", F.col("owner_username").alias("statement"), F.col("created_at").alias("rationale"))
    return insights.neighbours(_evidence(spark, sf_dir), nodes, "USER3 1997-06").select("id")


QUERIES = {
    "topic_classify": (_classified, _CLASSIFIED),
    "topic_histogram": (lambda s, d: _classified(s, d).groupBy("topic").agg(F.count("*").alias("n")), f"SELECT topic, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY topic"),
    "trust_score": (lambda s, d: urls.with_trust(_pages(s, d).select("page_id", "url"), "url", _registry(s)), _TRUST),
    "trust_tier_histogram": (lambda s, d: urls.with_trust(_pages(s, d).select("page_id", "url"), "url", _registry(s)).groupBy(F.round("trust_score", 2).alias("tier")).agg(F.count("*").alias("n")), f"SELECT round(trust_score, 2)::DOUBLE AS tier, count(*) AS n FROM ({_TRUST}) GROUP BY 1"),
    "url_normalize": (lambda s, d: _pages(s, d).select("page_id", urls.normalize(F.col("url")).alias("norm")), f"SELECT page_id, {_NORM} AS norm FROM pages"),
    "url_dedup_first_wins": (lambda s, d: windows.first_wins(_pages(s, d).select("page_id", "url"), urls.normalize(F.col("url")), "page_id"), f"SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT page_id, url, {_NORM} AS norm FROM pages) GROUP BY norm"),
    "url_shape_filter": (_shaped, _SHAPED),
    "filter_funnel": (_funnel, f"WITH s AS ({_SHAPED}), n AS (SELECT s.*, {_NORM} AS norm, shape IN ('whitelist', 'plain') AS good FROM s), f AS (SELECT norm, min(page_id) AS first FROM n WHERE good GROUP BY norm) SELECT CASE WHEN NOT good THEN 'bad_shape' WHEN page_id = first THEN 'stubbed' ELSE 'deduped' END AS reason, count(*) AS n FROM n LEFT JOIN f USING (norm) GROUP BY 1"),
    "page_title": (lambda s, d: _pages(s, d).select("page_id", text.page_title(F.col("html")).alias("title")), f"SELECT page_id, {_TITLE} AS title FROM pages"),
    "html_to_text": (lambda s, d: _pages(s, d).select("page_id", text.html_to_text(F.col("html")).alias("body")), _html_sql()),
    "page_links": (_links, r"""SELECT page_id, unnest(range(len(m))) AS pos, unnest(m) AS href, trim(unnest(l)) AS label FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"''#]+)["''][^>]*>([^<]{15,200})</a>', 1) AS m, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"''#]+)["''][^>]*>([^<]{15,200})</a>', 2) AS l FROM pages) WHERE len(m) > 0"""),
    "block_page_flag": (lambda s, d: _pages(s, d).select("page_id", (text.is_block_page(F.col("html")) | text.has(F.left("html", F.lit(2000)), P.ANTIBOT)).alias("blocked")), "SELECT page_id, (" + " OR ".join(f"contains(lower(left(html, 800)), '{m}')" for m in P.BLOCK_MARKERS) + f" OR regexp_matches(left(html, 2000), '{P.ANTIBOT}', 'i')) AS blocked FROM pages"),
    "first_sentences": (lambda s, d: _docs(s, d).select("doc_id", text.first_sentences(F.col("text")).alias("head")), f"SELECT doc_id, left({_SENT.replace('trim(b', 'trim(text')}, 600) AS head FROM documents"),
    "stub_rating": (_rated, f"WITH c AS ({_CLASSIFIED}), d AS (SELECT doc_id, text AS b, topic, len(regexp_extract_all(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])(the|of|que|der)([^\\p{{L}}\\p{{N}}_]|$)')) AS signals FROM documents JOIN c USING (doc_id)) SELECT doc_id, coalesce(nullif(left({_SENT}, 600), ''), '(нет текста)') AS summary, least(5, 1 + CAST(length(b) >= 200 AS INT) + CAST(length(b) >= 800 AS INT) + CAST(signals >= 2 AS INT) + CAST(contains(topic, 'банкинге') AS INT))::BIGINT AS rating, signals FROM d"),
    "doc_quality": (lambda s, d: _docs(s, d).select("doc_id", scores.document_quality(F.col("text"), F.when(F.col("lang") == "en", "url").otherwise("file"), F.concat(F.when(F.col("source") == "src1", "ftp://").otherwise("http://"), "source")).alias("q")).select("doc_id", "q.level", F.size("q.reasons").cast("long").alias("n_reasons")), "WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, lang = 'en' AS u, source = 'src1' AS f FROM documents) SELECT doc_id, CASE WHEN n < 60 THEN 'red' WHEN n < 200 OR (u AND (f OR n < 400)) THEN 'yellow' ELSE 'green' END AS level, (CAST(n < 200 AS INT) + CASE WHEN n >= 60 AND u THEN CAST(f AS INT) + CAST(n < 400 AS INT) ELSE 0 END)::BIGINT AS n_reasons FROM d"),
    "title_links": (_title_links, f"WITH {_TITLE_SQL}, l AS (SELECT a AS p FROM e UNION ALL SELECT b FROM e), c AS (SELECT tok, min(page_id) AS class_id FROM t WHERE len(tok) > 0 GROUP BY tok) SELECT t.page_id, coalesce(c.class_id, t.page_id) AS class_id, (SELECT count(*) FROM l WHERE l.p = t.page_id) AS n_links FROM t LEFT JOIN c ON c.tok = t.tok"),
    "near_dup_collapse": (_collapsed, _COLLAPSE_SQL),
    "archive_upsert": (_kept_archive, _KEPT_SQL),
    "diversity_cap": (lambda s, d: windows.round_robin(_docs(s, d).select("doc_id", "source"), 320, "source", "doc_id"), "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, source FROM r ORDER BY r, f LIMIT 320"),
    "host_cap_topn": (lambda s, d: windows.host_cap(_pages(s, d).select("page_id", urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang")), "host", 2, 20, ["lang"], "page_id"), f"WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages), a AS (SELECT *, row_number() OVER (PARTITION BY lang, host ORDER BY page_id) AS r FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS q FROM a WHERE r <= 2) SELECT page_id, host, lang FROM b WHERE q <= 20"),
    "candidate_merge_top200": (_merged, _MERGE_SQL),
    "field_merge": (_filled, "WITH l AS (SELECT doc_id, arg_min(CAST(quality AS VARCHAR), doc_id) AS q, max(CASE WHEN toxic = 1 THEN 'toxic' END) AS t FROM labels GROUP BY doc_id) SELECT doc_id, CASE WHEN lang = 'en' THEN lang ELSE q END AS relevance_reason, coalesce(t, '') AS trust_origin FROM documents LEFT JOIN l USING (doc_id)"),
    "story_group_primary": (_stories, _STORY_SQL),
    "incremental_docs": (_labels_docs, "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60) WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "evidence_graph": (_links_graph, "WITH e AS (SELECT DISTINCT l_orderkey AS n, l_partkey AS i FROM lineitem) SELECT x.n AS a, y.n AS b, count(*) AS w FROM e x JOIN e y ON x.i = y.i AND x.n < y.n GROUP BY 1, 2"),
    "evidence_counts": (lambda s, d: insights.with_evidence(_hypotheses(s, d), _evidence(s, d)).select("id", "n_evidence", "kind"), f"WITH {_HYP} SELECT id, n_evidence, kind FROM w"),
    "category_counts": (lambda s, d: insights.counts(_hypotheses(s, d), _evidence(s, d)), f"WITH {_HYP} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM w GROUP BY kind UNION ALL SELECT 'category', category, count(*) FROM w GROUP BY category"),
    "hypothesis_list": (lambda s, d: insights.page(insights.listing(_hypotheses(s, d), _evidence(s, d), "travel", "mixed"), 0).select("id", "validated", "n_evidence", F.round("confidence", 6).alias("confidence")), f"WITH {_HYP} SELECT id, validated, n_evidence, round(confidence, 6) AS confidence FROM w WHERE category = 'Travel' AND kind = 'mixed' ORDER BY validated DESC, n_evidence DESC, w.confidence DESC, id LIMIT 30"),
    "section_topn": (lambda s, d: insights.section(_hypotheses(s, d), _evidence(s, d), "packages", 20).select("id", "validated", "n_evidence", "created_at"), f"WITH {_HYP} SELECT id, validated, n_evidence, created_at FROM w WHERE category = '{P.CATEGORIES[0]}' ORDER BY validated DESC, confidence DESC, created_at DESC, id LIMIT 20"),
    "mine": (_mine, f"WITH {_HYP} SELECT id, next_check_at <= '{DAY}' AS overdue, left(created_at, 10) = '{DAY}' AND created_at >= '{DAY}T00:00:00' AS is_new, next_check_at FROM h WHERE owner = 'user3' OR left(created_at, 10) = '{DAY}'"),
    "mine_counters": (lambda s, d: insights.mine_counters(insights.mine(_hypotheses(s, d), "user3", f"{DAY}T12:00:00"), "user3"), f"WITH {_HYP} SELECT count(*) FILTER (owner = 'user3' AND lifecycle_status = 'in_review') AS in_review, count(*) FILTER (owner = 'user3' AND next_check_at <= '{DAY}') AS overdue, count(*) FILTER (left(created_at, 10) = '{DAY}') AS new, count(*) AS total FROM h WHERE owner = 'user3' OR left(created_at, 10) = '{DAY}'"),
    "badge": (lambda s, d: insights.badge(_hypotheses(s, d), "user3", DAY), f"WITH {_HYP} SELECT count(*) AS n FROM h WHERE owner = 'user3' AND (lifecycle_status = 'in_review' OR next_check_at <= '{DAY}')"),
    "lifecycle_board": (lambda s, d: insights.board(_hypotheses(s, d)), f"WITH {_HYP}, s AS (SELECT unnest(['synthesized', 'in_review', 'validated', 'adopted', 'archived']) AS status) SELECT status, count(h.id) AS n FROM s LEFT JOIN h ON h.lifecycle_status = status GROUP BY status"),
    "best_match": (_best, _BEST),
    "visibility_list": (lambda s, d: documents.listing(_rows(s, d), "fr", False, 100, 20).select("id", "moderation_status", "author"), "SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'pending' ELSE 'approved' END AS moderation_status, lang AS author FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') OR lang = 'fr' ORDER BY CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 100 OFFSET 20"),
    "fts_search_bm25": (_fts, _FTS),
    "phrase_search": (_phrases, _PHRASES),
    "job_metrics": (lambda s, d: jobs.metrics(_jobs(s, d)), _METRICS),
    "job_totals": (lambda s, d: jobs.totals(_jobs(s, d)), f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, 0 AS cancelled, 0 AS interrupted, 0 AS running, count(*) FILTER (status = 'queued') AS queued FROM j"),
    "queue_position": (lambda s, d: jobs.queue(_jobs(s, d)).select("id", "priority", "queue_pos"), f"WITH {_JOBS}, q AS (SELECT CAST(event_id AS VARCHAR) AS id, rank * 10000000000000 + ms AS priority FROM j WHERE status = 'queued') SELECT id, priority, count(*) OVER (ORDER BY priority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS queue_pos FROM q"),
    "job_retry": (lambda s, d: table(s, d, "events").select("event_id", scores.retry_delay(F.col("event_id") % 4).alias("delay_s")), "SELECT event_id, CAST(30 * pow(3, event_id % 4) AS BIGINT) AS delay_s FROM events"),
    "circuit_breaker": (_breaker, "WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), l AS (SELECT *, coalesce(max(CASE WHEN NOT coalesce(value < 60, false) THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM e), h AS (SELECT *, max(CASE WHEN r - 1 - last >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r) AS hit FROM l) SELECT user_id, count(*) AS asked, max(event_id) AS last_event FROM h WHERE hit = 0 GROUP BY user_id"),
    "freshness_filter": (_rss_dates, f"SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events WHERE event_type IN ('error', 'signup') OR date_trunc('second', ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY event_type"),
    "watchdog": (lambda s, d: documents.watchdog(_docs(s, d).withColumn("summary_ru", F.when(F.col("lang") == "en", F.col("text")).otherwise("")), "2024-01-30T10:00:00", AS_OF), "WITH d AS (SELECT count(*) AS total, count(*) FILTER (lang IS DISTINCT FROM 'en' OR trim(text) = '') AS empty FROM documents) SELECT total, empty, round(empty / total, 4) AS empty_share, 14.0::DOUBLE AS age_hours, false AS stale, empty / total >= 0.5 AND total >= 3 AS many_empty FROM d"),
    "reactions_snapshot": (lambda s, d: state.reaction_totals(state.reactions(_reader_events(s, d).where("kind = 'react'"))), "WITH l AS (SELECT event_id % 97 AS article_hash, user_id, arg_max(event_type, (ts, event_id)) AS a FROM events WHERE event_type <> 'view' GROUP BY 1, 2) SELECT article_hash, count(*) FILTER (a IN ('purchase', 'click')) AS likes, count(*) FILTER (a = 'error') AS dislikes FROM l WHERE a <> 'signup' GROUP BY 1"),
    "bookmark_toggle": (lambda s, d: state.bookmarks(_reader_events(s, d).where("kind = 'bookmark'")), "SELECT event_id % 97 AS article_hash, user_id AS \"user\" FROM events WHERE event_type = 'view' GROUP BY 1, 2 HAVING count(*) % 2 = 1"),
    "reader_feed": (lambda s, d: state.feed(_reader_events(s, d), 7).select("article_hash", "likes", "dislikes", "my", "bookmarked", "bookmark_total", F.array_join(F.col("top_reactors").cast("array<string>"), " ").alias("top")), "WITH l AS (SELECT event_id % 97 AS h, user_id AS u, arg_max(event_type, (ts, event_id)) AS a FROM events WHERE event_type <> 'view' GROUP BY 1, 2), r AS (SELECT h, count(*) FILTER (a IN ('purchase', 'click')) AS likes, count(*) FILTER (a = 'error') AS dislikes, max(CASE WHEN u = 7 AND a <> 'signup' THEN CASE WHEN a = 'error' THEN 'dislike' ELSE 'like' END END) AS my, array_to_string(list_sort(list(u) FILTER (a IN ('purchase', 'click') AND u <> 7))[1:3], ' ') AS top FROM l GROUP BY h), b AS (SELECT h, count(*) AS n, bool_or(u = 7) AS me FROM (SELECT event_id % 97 AS h, user_id AS u FROM events WHERE event_type = 'view' GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY h) SELECT k.h AS article_hash, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, my, coalesce(me, false) AS bookmarked, coalesce(b.n, 0) AS bookmark_total, coalesce(top, '') AS top FROM (SELECT DISTINCT event_id % 97 AS h FROM events) k LEFT JOIN r ON r.h = k.h LEFT JOIN b ON b.h = k.h"),
    "chat_tail": (_chat, "WITH c AS (SELECT conv_id, turn, role, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 6000) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') SELECT conv_id, turn, role, length(t) AS n FROM c WHERE r <= 30"),
    "props_json": (lambda s, d: table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"),
    "article_ids": (lambda s, d: _pages(s, d).select("page_id", urls.hash_url(F.col("url")).alias("hash_url"), urls.hash_url_title(F.col("url"), text.page_title(F.col("html"))).alias("hash_url_title"), urls.news_id(F.col("url")).alias("news_id")), f"SELECT page_id, left(sha256(url), 16) AS hash_url, left(sha256(url || chr(10) || {_TITLE}), 16) AS hash_url_title, 'news:' || left(sha256(url), 16) AS news_id FROM pages"),
    "latest_per_key": (_latest, "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM e WHERE r = 1"),
    "windowed_counts": (lambda s, d: incremental.windowed_counts(table(s, d, "events"), "ts", ["event_type"], "6 hours"), "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "category_normalize": (lambda s, d: _docs(s, d).select("doc_id", text.category(F.when(F.col("lang") == "en", "UX-UI").when(F.col("lang") == "fr", " Travel tips").when(F.col("lang") == "de", "ПУ / подписки").otherwise(F.col("source"))).alias("category")), "SELECT doc_id, CASE lang WHEN 'en' THEN 'UX/UI' WHEN 'fr' THEN 'Travel' WHEN 'de' THEN 'ПУ/подписки' ELSE '' END AS category FROM documents"),
    "confidence_clamp": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(scores.confidence((F.col("o_totalprice") / 250000).cast("string")), 6).alias("confidence"), scores.is_validated(scores.confidence((F.col("o_totalprice") / 250000).cast("string"))).alias("validated")), "SELECT o_orderkey, round(least(1.0, greatest(0.0, o_totalprice / 250000)), 6) AS confidence, CASE WHEN o_totalprice / 250000 > 0.9 THEN 1 ELSE 0 END AS validated FROM orders"),
    "snippet_dedup": (lambda s, d: windows.best_snippets(_docs(s, d).select("doc_id", "source", "text"), ["source"], order="doc_id").select("source", "doc_id", F.length("text").cast("long").alias("n")), "WITH t AS (SELECT doc_id, source, trim(text) AS t FROM documents), a AS (SELECT doc_id, source, left(t, 600) AS t, row_number() OVER (PARTITION BY source, lower(left(t, 60)) ORDER BY doc_id) AS r FROM t WHERE length(t) >= 30), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(t) DESC, doc_id) AS q FROM a WHERE r = 1) SELECT source, doc_id, length(t) AS n FROM b WHERE q <= 8"),
    "agent_reply_parse": (_events_reply, """SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 's' || user_id ELSE 'p' || event_id || chr(10) || chr(10) || 'q' END AS reply, CASE event_type WHEN 'error' THEN 'no reply' END AS error, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 'x' || event_id ELSE 'y' || user_id END AS session FROM events"""),
    "lifecycle_check": (_lifecycle, f"""WITH {_HYP}, a AS (SELECT id, lifecycle_status AS s, CASE WHEN id % 3 > 0 THEN 'User' || substr(owner, 5) END AS o, CASE id % 4 WHEN 0 THEN 'in_review' WHEN 1 THEN 'validated' WHEN 2 THEN 'archived' ELSE 'adopted' END AS t, id % 8 < 4 AS c FROM h),
      r AS (SELECT *, CASE WHEN s = t THEN 'unchanged' WHEN NOT ((s = 'synthesized' AND t IN ('in_review', 'archived')) OR (s = 'in_review' AND t IN ('validated', 'archived')) OR (s = 'validated' AND t IN ('adopted', 'archived'))) THEN 'transition_not_allowed' WHEN t = 'archived' AND NOT c THEN 'confirm_required' WHEN t IN ('validated', 'adopted') AND o IS NULL THEN 'assign_owner_first' ELSE 'ok' END AS result FROM a)
      SELECT id, result, CASE WHEN result = 'ok' THEN t ELSE s END AS lifecycle_status, CASE WHEN result = 'ok' AND t = 'in_review' AND o IS NULL THEN 'me' ELSE coalesce(o, '') END AS owner FROM r"""),
    "fetch_cascade": (_tiers, "WITH d AS (SELECT doc_id, lang, length(trim(text)) AS n, length(text) AS m, length(text) AS k, length(trim(text)) AS kt, (doc_id % 10) / 10.0 AS t FROM documents) SELECT doc_id, CASE WHEN lang = 'en' AND n >= 300 THEN 'direct' WHEN lang <> 'de' AND kt >= 400 THEN 'snippets' WHEN n >= 200 AND t >= 0.5 THEN 'paid' WHEN lang <> 'de' AND kt >= 200 THEN 'snippets' ELSE 'thin' END AS mode, CASE WHEN lang = 'en' AND n >= 300 THEN m WHEN lang <> 'de' AND kt >= 400 THEN k WHEN n >= 200 AND t >= 0.5 THEN m WHEN lang <> 'de' AND kt >= 200 THEN k ELSE 0 END AS n FROM d"),
    "news_snapshot": (_snapshot, f"""WITH p AS (SELECT page_id, url, {_TITLE} AS title FROM pages), u AS (SELECT 'news:' || CASE WHEN page_id % 2 = 0 THEN left(sha256(title), 16) ELSE left(sha256(url), 16) END AS id, 'travel' AS origin, url, 0 AS part, page_id FROM p UNION ALL SELECT 'news:' || left(sha256(url), 16), 'packages', url, 1, page_id FROM p)
      SELECT id, arg_min(origin, (part, page_id)) AS origin, arg_min(url, (part, page_id)) AS url FROM u GROUP BY id"""),
    "graph_neighbourhood": (_neighbours, f"WITH {_HYP}, g AS (SELECT DISTINCT l_orderkey AS n, CASE WHEN l_returnflag = 'A' THEN 'news:' ELSE '' END || l_partkey AS i FROM lineitem), s AS (SELECT id FROM h WHERE contains(lower(owner || ' ' || created_at), 'user3 1997-06')) SELECT id FROM s UNION SELECT y.n FROM g x JOIN g y ON x.i = y.i AND x.n <> y.n WHERE x.n IN (SELECT id FROM s)"),
    "inline_urls": (lambda s, d: _pages(s, d).select("page_id", F.array_join(text.inline_urls(F.concat(F.lit("see "), "url", F.lit(", and ("), "url", F.lit(") or http://x.y/a.PNG. "), "url", F.lit("2"))), " ").alias("found")), "SELECT page_id, regexp_replace(url, '[.,;:!?)>]+$', '') || ' ' || url || '2' AS found FROM pages"),
    "tag_cleaning": (lambda s, d: _docs(s, d).select("doc_id", text.clean_tags(F.replace("text", F.lit(" "), F.lit(",#"))).alias("tags")), r"WITH w AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), ' ', ',#'), ',')) AS x, generate_subscripts(string_split(replace(coalesce(text, ''), ' ', ',#'), ','), 1) AS p FROM documents), c AS (SELECT doc_id, p, regexp_replace(regexp_replace(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), '^#+', ''), '#+$', '') AS t FROM w), d AS (SELECT doc_id, t, min(p) AS p FROM c WHERE length(t) BETWEEN 1 AND 40 GROUP BY doc_id, t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM d), j AS (SELECT doc_id, string_agg(t, ',' ORDER BY p) AS tags FROM r WHERE r <= 7 GROUP BY doc_id) SELECT d.doc_id, coalesce(j.tags, '') AS tags FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id"),
    "query_routing": (lambda s, d: _pages(s, d).select("page_id", urls.route(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("site:"), urls.host(F.col("url")))).when(F.col("page_id") % 3 == 1, F.lit("путешествия")).otherwise(F.col("url"))).alias("r")).select("page_id", "r.lang", "r.engines"), f"SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'ru' WHEN page_id % 3 = 0 AND (contains(left({_HOST}, 30), '.ru') OR contains(left({_HOST}, 30), '.by')) THEN 'ru' ELSE 'en' END AS lang, CASE WHEN page_id % 3 = 1 THEN 'yandex,duckduckgo,bing' WHEN page_id % 3 = 0 AND (contains(left({_HOST}, 30), '.ru') OR contains(left({_HOST}, 30), '.by')) THEN 'yandex,bing,duckduckgo' WHEN page_id % 3 = 0 THEN 'bing,duckduckgo,brave' ELSE 'duckduckgo,bing,brave' END AS engines FROM pages"),
    "topic_gate": (lambda s, d: _docs(s, d).select("doc_id", text.on_topic(F.lit(""), F.col("text"), F.col("source"), r"\bthe\b", r"\bof\b", r"\band\b").alias("kept")), r"SELECT doc_id, regexp_matches(coalesce(text, ''), '^\s*$') OR regexp_matches(text, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', 'i') AS kept FROM documents"),
    "cache_ttl": (lambda s, d: archive.unexpired(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), AS_OF, 24).select("event_id"), f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"),
    "latest_health": (lambda s, d: documents.latest_health(table(s, d, "events").select(F.col("event_type").alias("mode"), F.struct("ts", "event_id").alias("finished_at"), "event_id", "user_id")).select("mode", "event_id", "user_id"), "SELECT event_type AS mode, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(user_id, (ts, event_id)) AS user_id FROM events GROUP BY 1"),
    "daily_increment": (lambda s, d: documents.evening(table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("collected_at")), "2024-01-15", 100), "SELECT count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') AS today, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') - 100 AS increment, count(*) AS total FROM events"),
    "summary_merge": (lambda s, d: documents.merged_summaries(_docs(s, d).select(F.col("doc_id").alias("id"), F.lit("old").alias("summary_ru")), _docs(s, d).where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"))).select("id", F.length("summary_ru").cast("long").alias("n")), r"SELECT doc_id AS id, CASE WHEN lang = 'en' AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200 THEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE 3 END AS n FROM documents"),
    "job_recovery": (lambda s, d: jobs.recovered(_jobs(s, d).withColumn("attempts", (F.col("id").cast("long") % 3).cast("int")).withColumn("status", F.when(F.col("status") == "queued", "running").otherwise(F.col("status"))), s.createDataFrame([("signup", True, False)], "kind string, recover boolean, serial boolean"), AS_OF).groupBy("kind", "status").agg(F.count("*").alias("n")), "SELECT event_type AS kind, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type <> 'signup' THEN 'done' WHEN event_id % 3 < 2 THEN 'queued' ELSE 'interrupted' END AS status, count(*) AS n FROM events GROUP BY 1, 2"),
    "processed_backfill": (lambda s, d: schemas.backfill_processed(table(s, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("r").alias("first_run_id"), F.lit("t").alias("processed_at")).distinct(), _docs(s, d).select(F.col("doc_id").cast("string").alias("doc_id")), "now").select("doc_id", "first_run_id"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'r' AS first_run_id FROM (SELECT DISTINCT doc_id FROM labels) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'legacy' FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "sessions": (lambda s, d: incremental.sessions(table(s, d, "events"), "ts", ["user_id"], "12 hours"), "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM g GROUP BY user_id, k"),
    "candidate_order": (lambda s, d: _docs(s, d).select("doc_id", F.col("n_chars").alias("n")).join(table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("trust_score")), "doc_id", "left").orderBy(F.desc(F.coalesce(F.nullif("trust_score", F.lit(0.0)), F.lit(0.1))), "doc_id").limit(200).where("n < 2000").select("doc_id", "n"), "WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), o AS (SELECT d.doc_id, n_chars AS n, CASE WHEN coalesce(q, 0) = 0 THEN 0.1 ELSE q END AS t FROM documents d LEFT JOIN l USING (doc_id) ORDER BY t DESC, d.doc_id LIMIT 200) SELECT doc_id, n FROM o WHERE n < 2000"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
