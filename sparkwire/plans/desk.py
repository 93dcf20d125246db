"""More operators over the driver's tables: fetching, the insight job's input, views, details, permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions import scores, text, urls
from sparkwire.operators import dedupe, documents, insights, jobs, state
from sparkwire.sources.readers import table

from . import flows
from .queries import _B, _HOST, _HYP, _JOBS, _NORM, _PATH, _SHAPE, _TITLE, _TITLE_SQL, _TRUST, DAY, QUERIES, REGISTRY, SHAPES, _evidence, _hypotheses, _jobs, _reader_events, _tiers, _titled


def _prefetched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("url", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    of = lambda lang: F.when(F.col("lang") == lang, F.col("text"))
    candidates = docs.select(F.col("doc_id").alias("seq"), "url", F.coalesce(of("fr"), F.lit("")).alias("article_text"), ((F.col("doc_id") % 10) / 10.0).alias("trust_score"))
    fetched = docs.select("url", of("en").alias("direct"), F.lit(None).cast("string").alias("page"), of("es").alias("snippets"), of("de").alias("paid"))
    return flows.prefetch(candidates, fetched)[0].select(F.col("seq").alias("doc_id"), F.length("article_text").cast("long").alias("n"))


_PREFETCHED = r"""WITH d AS (SELECT doc_id, lang, text, (doc_id % 10) / 10.0 AS t, CASE WHEN lang = 'fr' THEN text ELSE '' END AS own, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents),
  o AS (SELECT * FROM d ORDER BY CASE WHEN t = 0 THEN 0.1 ELSE t END DESC, doc_id LIMIT 200),
  g AS (SELECT doc_id, CASE WHEN lang = 'en' AND n >= 200 OR lang = 'es' AND n >= 200 OR lang = 'de' AND n >= 200 AND t >= 0.5 THEN left(text, 2500) END AS got
        FROM o WHERE length(regexp_replace(own, '^\s+|\s+$', '', 'g')) < 200)
  SELECT d.doc_id, length(coalesce(g.got, d.own)) AS n FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def _inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.when(F.col("source").isin("src1", "src2"), "pending").otherwise("approved").alias("moderation_status"),
        F.lit("text").alias("source_type"), F.col("lang").alias("source_ref"), F.lit("").alias("tags"), F.col("text").alias("content"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("created_at"),
    )
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("news:"), F.col("page_id").cast("string")).alias("id"), text.page_title(F.col("html")).alias("title"), F.lit("").alias("summary"), "url", F.lit("").alias("source"), F.lit("travel").alias("origin"), F.when(F.col("page_id") % 2 == 0, "AI").alias("case_type"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("collected_at"))
    seen = table(spark, sf_dir, "labels").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("doc_id"))
    out = insights.job_inputs(docs, pages, seen)
    return out.select("id", "kind", "source_ref", "tags", F.length("content").cast("long").alias("n"), F.col("seq.rank").cast("long").alias("place"))


_INPUTS = rf"""WITH m AS (SELECT * FROM (SELECT 'm' || doc_id AS id, lang, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS c, lpad(CAST(n_chars AS VARCHAR), 9, '0') AS made FROM documents WHERE source NOT IN ('src1', 'src2') OR source IS NULL) ORDER BY made DESC, id LIMIT 60),
  a AS (SELECT id, 'material' AS kind, coalesce(lang, '') AS source_ref, '' AS tags, c, made FROM m WHERE id NOT IN (SELECT 'm' || doc_id FROM labels)),
  b AS (SELECT 'news:' || page_id AS id, 'news' AS kind, url AS source_ref, 'news,travel' AS tags, CASE WHEN page_id % 2 = 0 THEN 'Тип: AI' ELSE {_TITLE} END AS c, lpad(CAST(page_id AS VARCHAR), 9, '0') AS made FROM pages ORDER BY made DESC, id LIMIT 60),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT id, kind, source_ref, tags, CASE WHEN length(c) > 2400 THEN length(regexp_replace(left(c, 2400), '\s+$', '')) + 1 ELSE length(c) END AS n, row_number() OVER (PARTITION BY kind ORDER BY made DESC, id) AS place FROM u"""


def _summary_batch(spark, sf_dir):
    """Every English document lacks a summary; the others' texts are what a fetch gives for its number plus one."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), F.col("source").alias("title"), F.when(F.col("doc_id") % 50 == 7, F.col("text")).otherwise("").alias("article_text"),
                        F.when(F.col("lang") == "en", "").otherwise("there is one").alias("summary_ru"), ((F.col("doc_id") % 10) / 10).alias("trust_score"), F.col("lang").alias("relevance_reason"))
    of = lambda c: F.when(c, F.col("text"))
    fetched = docs.select((F.col("doc_id") + 1).cast("string").alias("url"), of(F.col("lang") == "de").alias("direct"), of(F.col("lang") == "fr").alias("page"), of(F.col("lang") == "es").alias("snippets"), of(F.col("lang") == "en").alias("agent"))
    return flows.summary_batch(items, fetched, 100).select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n"), F.when(F.col("mode").isin("own", "fallback", "agent"), F.col("mode")).otherwise("fetched").alias("mode"))


_BLOCKED = " OR ".join(f"contains(lower(left(f.text, 800)), '{m}')" for m in P.BLOCK_MARKERS)
_SUMMARY_BATCH = rf"""WITH i AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 50 = 7 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS own, row_number() OVER (ORDER BY doc_id % 10 DESC, doc_id) AS r FROM documents WHERE lang = 'en'),
  j AS (SELECT i.*, f.text AS t, f.lang AS l, length(regexp_replace(f.text, '^\s+|\s+$', '', 'g')) AS n, length(f.text) AS m, {_BLOCKED} AS blocked FROM i LEFT JOIN documents f ON i.r <= 100 AND f.doc_id + 1 = i.doc_id),
  k AS (SELECT *, CASE WHEN own <> '' THEN 'own' WHEN l IN ('de', 'fr') AND n >= 200 AND m >= 300 AND NOT blocked OR l = 'es' AND n >= 200 AND m >= 300 THEN 'fetched' WHEN l = 'en' AND n >= 300 AND NOT blocked THEN 'agent' ELSE 'fallback' END AS mode FROM j)
  SELECT doc_id, mode, CAST(least(2500, CASE mode WHEN 'own' THEN length(own) WHEN 'fallback' THEN length(source || '. ' || lang) ELSE m END) AS BIGINT) AS n FROM k"""


def _dated(spark, sf_dir):
    """Near-duplicate titles of pages that were collected over a month, five days apart at most."""
    pages = _titled(spark, sf_dir).withColumn("collected_at", F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("seq") * 7 % 30).cast("int")), "yyyy-MM-dd"))
    lead = dedupe.leaders(pages.withColumn("key", F.struct("collected_at", "seq")), "title", "key")
    return lead.select(F.col("pos.seq").alias("page_id"), F.col("leader.seq").alias("leader"))


_DATED = f"""WITH RECURSIVE {_TITLE_SQL},
  o AS (SELECT page_id, page_id * 7 % 30 AS d, row_number() OVER (ORDER BY page_id * 7 % 30, page_id) AS pos FROM t),
  x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  f AS (SELECT p.pos AS a, q.pos AS b FROM x JOIN o p ON p.page_id = x.a JOIN o q ON q.page_id = x.b WHERE p.pos < q.pos AND p.d >= q.d - 5),
  n AS (SELECT o.pos, coalesce(list(f.a) FILTER (f.a IS NOT NULL), []) AS before FROM o LEFT JOIN f ON f.b = o.pos GROUP BY o.pos),
  s AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL
        SELECT n.pos, CASE WHEN len(list_intersect(s.kept, n.before)) > 0 THEN s.kept ELSE list_append(s.kept, n.pos) END FROM s JOIN n ON n.pos = s.pos + 1),
  k AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM s ORDER BY pos DESC LIMIT 1)),
  l AS (SELECT f.b, min(f.a) AS a FROM f SEMI JOIN k ON k.pos = f.a ANTI JOIN k AS kk ON kk.pos = f.b GROUP BY f.b)
  SELECT o.page_id, p.page_id AS leader FROM o LEFT JOIN l ON l.b = o.pos LEFT JOIN o p ON p.pos = l.a"""


def _detail(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hypothesis_id"), F.concat(F.when(F.col("l_returnflag") == "A", "news:").otherwise(""), F.col("l_partkey").cast("string")).alias("doc_id"), F.col("l_returnflag").alias("excerpt"), F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("is_origin"))
    part = table(spark, sf_dir, "part")
    docs = part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.expr("repeat(p_name, p_size)").alias("content"), F.lit("file").alias("source_type"), F.lit("").alias("source_ref"))
    news = part.where("p_size > 25").select(F.concat(F.lit("news:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("url"))
    hypotheses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("statement"))
    return insights.detail(7, hypotheses, item, docs, news).select("doc_id", "title", "url", "is_origin", "quality")


_DETAIL = """WITH e AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'news:' ELSE '' END || l_partkey AS doc_id, l_returnflag = 'A' AS news, l_partkey, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS is_origin FROM lineitem WHERE l_orderkey = 7)
  SELECT doc_id, CASE WHEN news THEN CASE WHEN p_size > 25 THEN p_name ELSE '(новость удалена)' END WHEN p_size > 10 THEN p_name ELSE '(документ удалён)' END AS title, CASE WHEN news AND p_size > 25 THEN p_brand END AS url, is_origin,
  CASE WHEN news THEN CASE WHEN p_size > 25 THEN 'amber' ELSE 'red' END WHEN p_size <= 10 OR length(p_name) * p_size < 60 THEN 'red' WHEN length(p_name) * p_size < 200 THEN 'yellow' ELSE 'green' END AS quality
  FROM e JOIN part ON p_partkey = l_partkey"""


def _users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("is_admin"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("kb"))).otherwise(F.array(F.lit("news"))).alias("sections"), (F.col("c_nationkey") == 3).alias("moderator"))
    return documents.can(users).select("c_custkey", "can_read", "can_upload", "can_moderate")


def _stubs(spark, sf_dir):
    hits = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), text.page_title(F.col("html")).alias("title"), "url", urls.host(F.col("url")).alias("source"), F.lit("").alias("query"), F.lit("").alias("pub"), F.lit("").alias("snippet"))
    return flows.stubs(hits, "2024-01-31T00:00:00", shapes=SHAPES, gate={"travel": r"\b(the|of|que)\b", "banking": "x", "ai": "x"}).select(F.col("seq").alias("page_id"), "url")


def _supplier_edges(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("hypothesis_id"), F.col("l_partkey").alias("doc_id"))
    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return insights.visible_edges(insights.graph(parts), nodes)


def _ranked(spark, sf_dir):
    h = insights.with_evidence(_hypotheses(spark, sf_dir), _evidence(spark, sf_dir))
    created = scores.parse_iso(F.col("created_at"))
    return h.select("id", F.round(scores.concentric(F.col("validated"), F.col("confidence"), F.col("n_evidence")).cast("double"), 6).alias("rank"), scores.day_label(created, F.to_timestamp(F.lit(f"{DAY}T12:00:00"))).alias("label"))


def _ensured(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, 0.77).alias("trust_score"), F.when(F.col("page_id") % 2 == 0, "kept").alias("trust_matched_domain"))
    out = urls.ensure_trust(pages, "url", spark.createDataFrame(REGISTRY, "domain string, score double"))
    return out.select("page_id", "trust_score", "trust_matched_domain")


def _reader(spark, sf_dir):
    out = state.detail(_reader_events(spark, sf_dir), 7, 7)
    return out.select("likes", "dislikes", "my_reaction", "bookmarked", "bookmark_total", F.array_join(F.col("likers_other").cast("array<string>"), " ").alias("likers"), F.array_join(F.col("dislikers_other").cast("array<string>"), " ").alias("dislikers"), "my_note", "my_chat_msgs", "team_chat_active")


_READER = """WITH l AS (SELECT user_id AS u, arg_max(event_type, (ts, event_id)) AS a FROM events WHERE event_type <> 'view' AND event_id % 97 = 7 GROUP BY 1),
  b AS (SELECT user_id AS u FROM events WHERE event_type = 'view' AND event_id % 97 = 7 GROUP BY 1 HAVING count(*) % 2 = 1)
  SELECT count(*) FILTER (a IN ('purchase', 'click')) AS likes, count(*) FILTER (a = 'error') AS dislikes, max(CASE WHEN u = 7 AND a <> 'signup' THEN CASE WHEN a = 'error' THEN 'dislike' ELSE 'like' END END) AS my_reaction,
  (SELECT coalesce(bool_or(u = 7), false) FROM b) AS bookmarked, (SELECT count(*) FROM b) AS bookmark_total,
  coalesce(array_to_string(list_sort(list(u) FILTER (a IN ('purchase', 'click') AND u <> 7))[1:10], ' '), '') AS likers, coalesce(array_to_string(list_sort(list(u) FILTER (a = 'error' AND u <> 7))[1:10], ' '), '') AS dislikers,
  '' AS my_note, 0::BIGINT AS my_chat_msgs, 0::BIGINT AS team_chat_active FROM l"""


def _routed(spark, sf_dir):
    """Texts of one language from each tier; two sources' hosts are read through the proxy."""
    docs = table(spark, sf_dir, "documents")
    of = lambda *langs: F.when(F.col("lang").isin(*langs), F.col("text"))
    url = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", url.alias("url"), of("en", "de").alias("extracted"), of("de", "fr").alias("proxied"), of("es", "fr", "en").alias("plain"))
    return documents.routed(rows, r"(^|\.)(src1|src3)\.example\.com$").select("doc_id", "tier", F.length("fetched_text").cast("long").alias("n"))


_ROUTED = rf"""WITH d AS (SELECT *, regexp_matches(left(text, 2000), '{P.ANTIBOT}', 'i') AS robots, source IN ('src1', 'src3') AS proxied FROM documents),
  e AS (SELECT *, CASE WHEN source IS NULL THEN 'none' WHEN lang IN ('en', 'de') AND length(text) >= 200 AND NOT robots THEN 'extracted' WHEN proxied THEN 'proxied' ELSE 'plain' END AS tier FROM d)
  SELECT doc_id, tier, CASE WHEN tier = 'extracted' OR NOT coalesce(robots, false) AND (tier = 'proxied' AND lang IN ('de', 'fr') OR tier = 'plain' AND lang IN ('es', 'fr', 'en')) THEN length(left(coalesce(text, ''), 2500)) ELSE 0 END AS n FROM e"""


def _replies(spark, sf_dir):
    """A reply for each document: one hypothesis whose sources name it, the next one, it again, and nothing."""
    kind = F.when(F.col("lang") == "en", F.lit(P.CATEGORIES[0])).when(F.col("lang") == "de", F.lit(P.CATEGORIES[1])).otherwise("")
    name = lambda k: F.concat(F.lit("m"), (F.col("doc_id") + k).cast("string"))
    source = lambda doc, excerpt, origin: F.struct(doc.alias("doc_id"), excerpt.alias("excerpt"), F.lit(origin).alias("is_origin"))
    sources = F.array(source(name(0), F.col("text"), True), source(name(1), F.col("source"), False), source(name(0), F.lit("again"), False), source(F.lit(""), F.lit("none"), True))
    reply = F.struct(F.array(F.struct(F.col("source").alias("statement"), F.lit("").alias("rationale"), kind.alias("category"), F.lit("0.5").alias("confidence"), sources.alias("sources"))).alias("hypotheses"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), F.concat(F.lit("Here it is: "), F.to_json(reply)).alias("raw"))


def _validated(spark, sf_dir):
    valid = table(spark, sf_dir, "labels").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"))
    found = insights.valid_evidence(insights.parsed(_replies(spark, sf_dir)), valid)
    return found.select("run_id", "doc_id", F.length("excerpt").cast("long").alias("n"), F.col("is_origin").cast("long").alias("is_origin"))


_VALIDATED = r"""WITH d AS (SELECT * FROM documents WHERE lang IN ('en', 'de') AND regexp_replace(coalesce(source, ''), '^\s+|\s+$', '', 'g') <> ''),
  s AS (SELECT doc_id AS run, 0 AS k, text AS x, 1 AS o FROM d UNION ALL SELECT doc_id, 1, source, 0 FROM d)
  SELECT CAST(run AS VARCHAR) AS run_id, 'm' || (run + k) AS doc_id, length(regexp_replace(left(coalesce(x, ''), 400), '^\s+|\s+$', '', 'g')) AS n, o::BIGINT AS is_origin
  FROM s SEMI JOIN labels l ON l.doc_id = s.run + s.k"""


def _cleaned(spark, sf_dir):
    """Jobs of events, and each event as one of the job with half its number."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2).cast("string").alias("job_id"))
    kept, left = jobs.cleaned(_jobs(spark, sf_dir), events, "2024-02-14T12:00:00")
    return kept.select(F.lit("job").alias("part"), "id").unionByName(left.select(F.lit("event").alias("part"), F.col("seq").cast("string").alias("id")))


_CLEANED = """WITH k AS (SELECT event_id FROM events WHERE event_type = 'signup' OR ts + to_seconds(event_id % 100 + event_id % 977) >= TIMESTAMP '2024-01-15 12:00:00')
  SELECT 'job' AS part, CAST(event_id AS VARCHAR) AS id FROM k UNION ALL SELECT 'event', CAST(e.event_id AS VARCHAR) FROM events e SEMI JOIN k ON k.event_id = e.event_id // 2"""


def _prompted(spark, sf_dir):
    """The message of the latest documents that no job has read."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("kind"), F.col("source").alias("title"), F.col("lang").alias("source_ref"), F.when(F.col("doc_id") % 2 == 0, "a,b").alias("tags"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    seen = table(spark, sf_dir, "labels").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("doc_id"))
    whole = insights.prompt(insights.unprocessed(docs, seen, [F.desc("seq")]), "Read these.")
    message = text.in_language(F.col("prompt"))
    return whole.select(F.length(message).cast("long").alias("n"), F.md5(message.cast("binary")).alias("digest"))


_PROMPTED = rf"""WITH d AS (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 60), p AS (SELECT 'Read these.' || coalesce(string_agg(chr(10) || '--- DOC id=m' || doc_id || ' | kind=material | title=' || coalesce(source, '') ||
    CASE WHEN coalesce(lang, '') <> '' THEN ' | source=' || left(lang, 80) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | tags=a,b' ELSE '' END || ' ---' || chr(10) || coalesce(text, ''), '' ORDER BY doc_id), '') AS p
  FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
  m AS (SELECT CASE WHEN length(p) > 180000 THEN left(p, 180000) || chr(10) || '… [обрезано по лимиту]' ELSE p END || '{P.LANGUAGE_HINT}' AS m FROM p)
  SELECT length(m) AS n, md5(m) AS digest FROM m"""


def _claimed(spark, sf_dir):
    """Each hypothesis is claimed for some user by another or an admin, then given a date by the claimer."""
    user = lambda c: F.concat(F.lit("User"), c.cast("string"))
    own = _hypotheses(spark, sf_dir).withColumn("owner_username", F.when(F.col("id") % 3 > 0, F.col("owner_username")))
    date = F.when(F.col("id") % 4 == 0, "2024-02-30").when(F.col("id") % 4 == 1, "").otherwise("2024-03-01")
    event = lambda seq, kind, value, admin: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), value.alias("value"), (F.col("id") % admin == 0).alias("is_admin"))
    both = own.select("id", F.explode(F.array(event(1, "owner", user(F.col("id") % 10), 7), event(2, "next_check", date, 11))).alias("e"))
    events = both.select(F.col("id").cast("string").alias("id"), "e.*", user(F.col("id") % 5).alias("caller"), F.lit(False).alias("confirm"))
    return state.fold(own.withColumn("id", F.col("id").cast("string")), events).select("id", "seq", "result", F.coalesce("owner_username", F.lit("")).alias("owner"), F.coalesce("next_check_at", F.lit("")).alias("next_check"))


_CLAIMED = f"""WITH {_HYP}, a AS (SELECT id, CASE WHEN id % 3 > 0 THEN 'User' || substr(owner, 5) END AS o, 'User' || (id % 10) AS who, 'User' || (id % 5) AS me, next_check_at AS c, CASE id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '' ELSE '2024-03-01' END AS d FROM h),
  b AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'ok' WHEN who <> me THEN 'forbidden' WHEN o IS NOT NULL AND o <> me THEN 'already_owned' ELSE 'ok' END AS r FROM a),
  x AS (SELECT *, CASE WHEN r = 'ok' THEN who ELSE o END AS n FROM b),
  y AS (SELECT *, CASE WHEN d = '2024-02-30' THEN 'bad_date' WHEN id % 11 > 0 AND coalesce(n, '') <> me THEN 'forbidden' ELSE 'ok' END AS q FROM x)
  SELECT CAST(id AS VARCHAR) AS id, 1::BIGINT AS seq, r AS result, coalesce(n, '') AS owner, c AS next_check FROM y
  UNION ALL SELECT CAST(id AS VARCHAR), 2, q, coalesce(n, ''), CASE WHEN q = 'ok' THEN d ELSE c END FROM y"""

MORE = {
    "lifecycle_claims": (_claimed, _CLAIMED),
    "routed_fetch": (_routed, _ROUTED),
    "evidence_valid": (_validated, _VALIDATED),
    "job_cleanup": (_cleaned, _CLEANED),
    "insight_prompt": (_prompted, _PROMPTED),
    "fetch_modes": (lambda s, d: documents.modes(_tiers(s, d)), f"SELECT mode, count(*) AS n FROM ({QUERIES['fetch_cascade'][1]}) GROUP BY mode"),
    "prefetch_flow": (_prefetched, _PREFETCHED),
    "summary_flow": (_summary_batch, _SUMMARY_BATCH),
    "insight_inputs": (_inputs, _INPUTS),
    "near_dup_dated": (_dated, _DATED),
    "evidence_detail": (_detail, _DETAIL),
    "permissions": (_users, "SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_acctbal > 0 AS can_read, c_mktsegment = 'BUILDING' OR c_acctbal > 0 AS can_upload, c_mktsegment = 'BUILDING' OR c_nationkey = 3 AS can_moderate FROM customer"),
    "stub_flow": (_stubs, f"WITH s AS (SELECT page_id, url, {_TITLE} AS title, {_NORM} AS norm, {_SHAPE} AS shape FROM (SELECT *, {_HOST} AS h, {_PATH} AS p FROM pages)), g AS (SELECT * FROM s WHERE shape IN ('whitelist', 'plain') AND (title = '' OR regexp_matches(title, '{_B.replace('{}', 'the|of|que', 1)}', 'i'))) SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url FROM g GROUP BY norm"),
    "visible_edges": (_supplier_edges, "WITH e AS (SELECT DISTINCT l_suppkey AS n, l_partkey AS i FROM lineitem SEMI JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s.s_suppkey = l_suppkey) SELECT x.n AS a, y.n AS b, count(*) AS w FROM e x JOIN e y ON x.i = y.i AND x.n < y.n GROUP BY 1, 2"),
    "hypothesis_view": (lambda s, d: insights.filtered(_hypotheses(s, d), False, "Travel", "material", "validated").select("id", "category"), f"WITH {_HYP} SELECT id, category FROM h WHERE category = 'Travel' AND validated = 1"),
    "header_counts": (lambda s, d: insights.header(insights.with_evidence(_hypotheses(s, d), _evidence(s, d)).withColumn("evidence_count", F.col("n_evidence"))), f"WITH {_HYP} SELECT count(*) AS total, count(*) FILTER (validated = 1) AS validated, count(*) FILTER (n_evidence <= 1) AS single, count(*) FILTER (lifecycle_status <> 'archived') AS asis, count(*) FILTER (lifecycle_status = 'archived') AS archive FROM w"),
    "hypothesis_rank": (_ranked, f"WITH {_HYP} SELECT id, round((100 * validated + 40 * confidence + least(20, 2 * n_evidence))::DOUBLE, 6) AS rank, CASE WHEN left(created_at, 10) = '{DAY}' THEN 'today' WHEN CAST(left(created_at, 10) AS DATE) = DATE '{DAY}' - 1 THEN 'yesterday' ELSE strftime(CAST(left(created_at, 10) AS DATE), '%-d %b') END AS label FROM w"),
    "active_job": (lambda s, d: jobs.find_active(_jobs(s, d), "signup").select("id", "submitted_at"), f"WITH {_JOBS} SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS submitted_at FROM events WHERE event_type = 'signup' ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 1"),
    "recent_jobs": (lambda s, d: jobs.admin_list(_jobs(s, d))["recent"].select("id", "kind"), "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_type <> 'signup' ORDER BY ts + to_seconds(event_id % 100 + event_id % 977) DESC, CAST(event_id AS VARCHAR) LIMIT 50"),
    "ensure_trust": (_ensured, f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0.77 ELSE trust_score END::DOUBLE AS trust_score, CASE WHEN page_id % 2 = 0 THEN 'kept' ELSE trust_matched_domain END AS trust_matched_domain FROM ({_TRUST})"),
    "reader_detail": (_reader, _READER),
}


def queries() -> dict:
    return {name: run for name, (run, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in MORE.items() if sql}
