"""Readers, sinks and streams over small files."""

from collections import Counter

from pyspark.sql import functions as F

from sparkwire.functions.python import article_text, summarise
from sparkwire.operators import archive, dedupe, windows
from sparkwire.plans import flows
from sparkwire.sources import readers, schemas, sinks
from sparkwire.streaming import incremental

RSS = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title> Hotel news </title><link>https://a.b/news/1</link><pubDate>Wed, 06 May 2026 00:00:00 GMT</pubDate><source>A</source><description>x</description></item>
<item><title>Second</title><link>https://a.b/news/2</link></item><item><title>Third</title><link>https://a.b/news/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><title>f</title><entry><title>Entry</title><link rel="alternate" href="https://c.d/1"/><updated>2026-05-06T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RSS)
    (tmp_path / "a.xml").write_text(ATOM)
    got = readers.rss(spark, str(tmp_path / "r.xml"), top=2).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["url"], r["pub"]) for r in got] == [(1, "Hotel news", "https://a.b/news/1", "Wed, 06 May 2026 00:00:00 GMT"), (2, "Second", "https://a.b/news/2", "")]
    assert [r["snippet"] for r in readers.rss(spark, str(tmp_path / "r.xml"), 1, snippet=False).collect()] == [""]
    both = readers.direct(spark, str(tmp_path / "*.xml"))
    assert Counter(r["title"] for r in both.collect()) == Counter(["Hotel news", "Second", "Third", "Entry"])
    assert both.where("title = 'Entry'").first()["url"] == "https://c.d/1"


def test_text_sources(spark, tmp_path):
    (tmp_path / "feeds.txt").write_text("# c\n\nhttps://a\n https://b \n")
    assert [r["feed"] for r in readers.feed_list(spark, str(tmp_path / "feeds.txt")).collect()] == ["https://a", "https://b"]
    (tmp_path / "runs.jsonl").write_text('{"summary": "1. 📰 **T** — 🔗 https://t.me/c/1", "runAtMs": 0, "ts": 5}\n\nbroken\n{"summary": "none", "ts": 1}\n')
    got = readers.digest_runs(spark, str(tmp_path / "runs.jsonl")).collect()
    assert [(r["run_ms"], len(r["items"])) for r in got] == [(5, 1)]
    for name, body in {"bare": '[{"url": "u1", "trust_score": 0.5}]', "candidates": '{"candidates": [{"url": "u1", "trust_score": 0.5}], "errors": []}', "urls": '{"urls": [{"url": "u1", "trust_score": 0.5}]}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
        assert [(r["seq"], r["url"], r["trust_score"]) for r in readers.candidates(spark, str(tmp_path / f"{name}.json")).collect()] == [(0, "u1", 0.5)], name
    (tmp_path / "d.md").write_text("# hé")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["ext"]: (r["content"], r["needs_reader"]) for r in readers.files(spark, str(tmp_path / "d.*")).collect()}
    assert got == {"md": ("# hé", False), "pdf": (None, True)}
    assert readers.document_files(spark, str(tmp_path / "d.pdf"), lambda data, ext: f"{ext}{len(data)}").first()["content"] == "pdf4"


def test_search_hits(spark):
    body = '{"results": [' + ",".join(f'{{"url": "{u}"}}' for u in ("http://a/1", "http://a/2", "http://a/3", "ftp://x", "http://yandex.ru/1", "http://b/clck/1", "http://b/2", "http://c/1")) + "]}"
    df = spark.createDataFrame([("q", 1, body)], "query string, seq long, body string")
    assert [r["url"] for r in readers.search_hits(df, 2, 3).orderBy("pos").collect()] == ["http://a/1", "http://a/2", "http://b/2"]


def test_listing_links(spark):
    html = "".join(f'<a class="x" href="{h}">{t}</a>' for h, t in (("/news/1", "A title that is long enough"), ("/news/1", "Another title for the same link"), ("https://other.z/1", "A link to some other site"), ("/x/tag/", "A tag of the listing page"), ("https://www.s.t/2", "short"), ("https://www.s.t/3", "Absolute link with long title")))
    df = spark.createDataFrame([("https://www.s.t/list", html)], "url string, html string")
    assert [r["href"] for r in readers.listing_links(df).orderBy("pos").collect()] == ["https://www.s.t/news/1", "https://www.s.t/3"]


def test_fetched_pages(spark):
    df = spark.createDataFrame([("http://a", "<title>T</title><p>" + "word " * 100 + "</p>", None), ("http://b", "Just a moment", "f" * 250), ("ftp://c", "x", None)], "url string, html string, fallback string")
    got = {r["url"]: (r["title"], len(r["content"])) for r in readers.fetched_pages(df).collect()}
    assert got["http://a"][0] == "T" and got["http://b"][1] == 250 and "ftp://c" not in got


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert sinks.replace(df, path) == 5
    assert sinks.replace(spark.read.parquet(path).where("id > 2"), path) == 2
    sinks.append(spark.range(1), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.drop(spark, path) and readers.archive(spark, path).count() == 0
    items = spark.createDataFrame([(0, "u", "x" * 199), (1, "u", "x" * 300), (2, "v", "y" * 20_000)], "seq long, url string, article_text string")
    assert sorted(len(r["text"]) for r in sinks.articles(items).collect()) == [300, 12_000]


def test_backend_and_article_text(spark):
    class Backend:
        def summarize_and_rate(self, title, text, topic):
            return {"summary": title.upper(), "rating": 9}

    df = spark.createDataFrame([("a", None, "t")], "title string, text string, topic string")
    assert [(r["summary"], r["rating"]) for r in summarise(df, Backend()).collect()] == [("A", 5)]
    html = spark.createDataFrame([("<p>long enough text</p><script>x</script>",)], "h string")
    assert html.select(article_text(F.col("h")).alias("t")).first()["t"] == "long enough text"


def _items(spark, data):
    kind = "seq long, article_hash string, title string, url string, source string, trust_score double, collected_at string, summary_ru string"
    return spark.createDataFrame([(i, h, t, f"http://s/{h}", "s", 0.5, "2026-05-01T00:00:00Z", "") for i, (h, t) in enumerate(data)], kind)


def test_stream_equals_batch(spark, tmp_path):
    """Micro-batches of an availableNow stream make the archive that the same upserts in batch make."""
    parts = [_items(spark, [("a", "one two three four"), ("b", "five six seven")]), _items(spark, [("c", "one two three four"), ("d", "eight nine ten"), ("a", "one two three four")])]
    source, target = str(tmp_path / "in"), str(tmp_path / "archive")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
        query = incremental.archive_stream(spark.readStream.schema(p.schema).parquet(source), target, str(tmp_path / "ck"), lambda n: "2026-05-02T00:00:00Z")
        query.awaitTermination(120)
    batch = readers.archive(spark, str(tmp_path / "none"))
    for p in parts:
        batch = archive.upsert(batch, p, "2026-05-02T00:00:00Z")
    key = lambda df: {(r["article_hash"], tuple(d["url"] for d in r["dup_sources"])) for r in df.collect()}
    assert key(readers.archive(spark, target)) == key(batch) == {("a", ("http://s/c",)), ("b", ()), ("d", ())}


def test_latest_stream_and_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "seq long, k string, v int")
    df.write.parquet(str(tmp_path / "in"))
    q = incremental.latest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "seq")
    q.awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 3)]
    events = spark.createDataFrame([("x", "2026-01-01 00:10:00"), ("x", "2026-01-01 00:50:00"), ("x", "2026-01-01 02:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    assert [r["n"] for r in incremental.windowed_counts(events, "t", ["k"]).orderBy("window_start").collect()] == [2, 1]
    assert [r["n"] for r in incremental.sessions(events, "t", ["k"], "45 minutes").orderBy("session_start").collect()] == [2, 1]


def test_collect_flow(spark):
    hits = spark.createDataFrame(
        [
            (0, "Hotel AI agents", "https://news.x.com/news/1?utm_a=1", "A", "q", "Wed, 06 May 2026 00:00:00 GMT", ""),
            (1, "Hotel AI agents again", "https://news.x.com/news/1", "A", "q", "", ""),
            (2, "Old hotel", "https://news.x.com/news/2", "B", "q", "Tue, 05 May 2026 00:00:00 GMT", ""),
            (3, "Hotel page", "https://news.x.com/cards/", "B", "q", "", ""),
            (4, "Weather", "https://news.x.com/news/4", "B", "q", "", ""),
            (5, "Flight news", "https://low.y.com/news/5", "C", "q", "", ""),
        ],
        "seq long, title string, url string, source string, query string, pub string, snippet string",
    )
    now = "2026-05-07T00:00:00Z"
    assert dict(flows.funnel(hits, now).collect()) == {"stubbed": 2, "deduped": 1, "stale": 1, "bad_shape": 1, "offtopic": 1}
    registry = spark.createDataFrame([("x.com", 0.85)], "domain string, score double")
    redirects = spark.createDataFrame([], "url string, final_url string")
    texts = spark.createDataFrame([("https://news.x.com/news/1?utm_a=1", "travel and AI " * 50), ("https://low.y.com/news/5", "never read " * 50)], "url string, text string")
    out = flows.collect(hits, schemas.empty(spark, "candidate"), redirects, texts, registry, now)
    got = {r["seq"]: r for r in out.collect()}
    assert set(got) == {0, 5}
    assert (got[0]["trust_score"], got[0]["case_type"], len(got[0]["article_text"])) == (0.85, "AI travel", 700)
    assert (got[5]["trust_score"], got[5]["case_type"], got[5]["article_text"]) == (0.1, None, "")
    assert [r["seq"] for r in flows.prefetch_targets(out).collect()] == [5]
    assert [tuple(r) for r in flows.trust_tiers(out).collect()] == [(0.85, 1), (0.1, 1)]


def test_demo_flow(spark):
    entries = spark.createDataFrame(
        [(0, "f", 1, "Hotel uses AI agents for guests", "https://x.com/1", "<b>AI</b> launch first", None), (1, "f", 2, "Hotel uses AI agents for guests", "https://x.com/2", "", None), (2, "f", 3, "Weather", "https://x.com/3", "", None), (3, "f", 26, "Hotel AI", "https://x.com/4", "", None), (4, "f", 4, "Hotel and Visa card", None, "", "full " * 50)],
        "seq long, feed string, pos int, title string, link string, summary string, full_text string",
    )
    registry = spark.createDataFrame([("x.com", 0.85)], "domain string, score double")
    out = flows.demo(entries, registry, "2026-05-07T00:00:00Z")
    got = {r["seq"]: r for r in out.collect()}
    assert set(got) == {0, 4} and [d["url"] for d in got[0]["dup_sources"]] == ["https://x.com/2"]
    assert (got[0]["trust_score"], got[4]["url"], got[4]["fetch_mode"], got[4]["rating"]) == (0.85, "f", "full", 3)
    shown = flows.report(out)
    assert [r["seq"] for r in shown["top"].collect()] == [0, 4] and shown["topics"].count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([(0, "k", "old"), (1, "j", "old")], "seq long, id string, v string")
    new = spark.createDataFrame([(0, "k", "n1"), (1, "k", "n2"), (2, "z", "n")], "seq long, id string, v string")
    assert {r["id"]: r["v"] for r in archive.upsert_rows(old, new, "id").collect()} == {"k": "n2", "j": "old", "z": "n"}
    assert {r["id"]: r["v"] for r in archive.upsert_rows(old, new, "id", replace=False).collect()} == {"k": "old", "j": "old", "z": "n"}
    assert windows.first_wins(new, "id").count() == 2
    assert dedupe.dup_ref("title") is not None
