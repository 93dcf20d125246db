"""Flows, the insight job, indexes, and tables that survive a lost writer."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwire.functions import scores, text, urls
from sparkwire.functions.python import first_object
from sparkwire.operators import documents, insights, jobs, search, state, windows
from sparkwire.plans import flows
from sparkwire.sources import readers, schemas, sinks


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def _archive(spark, *titles):
    return schemas.migrate(spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "seq long, title string"), "archive")


@pytest.mark.parametrize("step", range(3))
def test_a_lost_writer_loses_no_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "archive")
    assert readers.archive(spark, path).count() == 0
    sinks.replace(_archive(spark, "old"), path)
    rename, calls = sinks._rename, []

    def lost(fs, old, new):
        calls.append(1)
        if len(calls) > step:
            raise OSError("lost")
        rename(fs, old, new)

    monkeypatch.setattr(sinks, "_rename", lost)
    if step < 2:
        with pytest.raises(OSError):
            sinks.replace(_archive(spark, "old", "new"), path)
        assert rows(readers.archive(spark, path), "title") == [("old",)]
    monkeypatch.undo()
    old = readers.archive(spark, path)
    assert sinks.replace(old.unionByName(_archive(spark, "new")), path) == 2
    assert sorted(rows(readers.archive(spark, path), "title")) == [("new",), ("old",)]


def test_first_object():
    assert first_object('noise {bad} then {"a":"}{"} tail') == '{"a":"}{"}'
    assert first_object("none") is None and first_object(None) is None and first_object("{" * 5000) is None
    assert first_object('{x {"b": [1, {"c": 2}]}') == '{"b": [1, {"c": 2}]}'


def test_breaker_over_all_rows_is_the_loop(spark):
    n = [1, 0, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame(list(enumerate(n)), "seq int, n int").repartition(3)
    for limit, want in ((1, 2), (2, 3), (3, 7), (4, 9)):
        assert windows.until_breaker(df, F.col("n") == 0, limit).count() == want
    with pytest.raises(ValueError):
        windows.empty_runs(df, F.col("n") == 0)


def test_guarded_limits_by_kind(spark):
    df = spark.createDataFrame([(0, "SITE:a.b x", 1, 1.0), (1, "x", 0, 2.0), (2, "y", 1, 400.0)], "seq int, query string, n_hits int, elapsed_s double")
    assert sorted(rows(readers.guarded(df), "seq", "max_hits")) == [(0, 5), (1, 10)]


def test_listing_selectors(spark):
    html = '<a href="/news/1">a label of some length</a><a href="/shop/2">a label of some length</a>'
    df = spark.createDataFrame([("https://www.site.com/list", html), ("https://other.com/list", html)], "url string, html string")
    got = readers.listing_links(df, selectors={"site.com": ["/news/"]})
    assert sorted(rows(got, "href")) == [("https://other.com/news/1",), ("https://other.com/shop/2",), ("https://www.site.com/news/1",)]


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    df = spark.createDataFrame([(1, "onboarding card card", "x"), (2, "onboard", "cards"), (3, "card", ""), (4, None, None)], "id long, title string, content string")
    want = rows(search.search(df, "id", ["title", "content"], "onb card"), "id", "score")
    postings, lengths = search.index(df, "id", ["title", "content"])
    search.stored(postings, lengths, str(tmp_path / "i"))
    postings, lengths = (spark.read.parquet(str(tmp_path / "i" / n)) for n in ("postings", "lengths"))
    got = rows(search.search_index(postings, lengths, "onb card"), "id", "score")
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want, strict=True))
    assert search.search_index(postings, lengths, " ").count() == 0
    assert rows(search.search_index(postings, lengths, "card", visible=spark.createDataFrame([(3,)], "id long")), "id") == [(3,)]
    gone = spark.createDataFrame([(2,), (3,)], "id long")
    p, n = search.reindexed(postings, lengths, df.where("id = 3"), gone, "id", ["title", "content"])
    assert n.count() == 3 and p.where("id = 2").count() == 0 and p.where("id = 3").count() == 1


def _kb(spark):
    docs = schemas.migrate(spark.createDataFrame([("d1", "A", "first " * 600, "approved", "1"), ("d2", "B", "second", "approved", "2"), ("d3", "C", "third", "pending", "3")], "id string, title string, content string, moderation_status string, created_at string"), "kb_docs")
    news = schemas.migrate(spark.createDataFrame([("news:1", "N", "", "u", "", "travel", "AI", "5")], "id string, title string, summary string, url string, source string, origin string, case_type string, collected_at string"), "kb_news_items")
    return docs, news


def test_insight_job(spark):
    docs, news = _kb(spark)
    empty = {n: schemas.empty(spark, n) for n in ("kb_hypotheses", "kb_hypothesis_sources", "kb_insight_docs")}
    seen = []

    def model(prompts):
        seen.append(prompts.first()["prompt"])
        reply = {"hypotheses": [{"statement": "People travel more", "rationale": "r", "category": "travel", "confidence": 0.95, "sources": [{"doc_id": "d2", "excerpt": "x", "is_origin": True}, {"doc_id": "news:1"}, {"doc_id": "none"}]}]}
        return prompts.select("run_id", F.lit("sure: " + json.dumps(reply)).alias("raw"))

    got = insights.insight_job(docs, news, *empty.values(), model, "r1", "2026-01-01T00:00:00", "HEAD")
    assert seen[0].startswith("HEAD\n--- DOC id=d2") and "third" not in seen[0] and seen[0].index("id=d1") < seen[0].index("id=news:1") and "Тип: AI" in seen[0]
    run = got["run"].first()
    assert (run["status"], run["docs_total"], run["hypotheses_total"], run["validated_total"], run["new_materials"], run["new_news"], run["incremental"]) == ("done", 3, 1, 1, 2, 1, False)
    assert rows(got["hypotheses"], "statement", "source_kind", "evidence_count") == [("People travel more", "mixed", 2)]
    assert sorted(x for x, in rows(got["processed"], "doc_id")) == ["d1", "d2", "news:1"]
    again = insights.insight_job(docs, news, got["hypotheses"], got["evidence"], got["processed"], model, "r2", "t")
    assert again["run"].first()["status"] == "error" and len(seen) == 1 and again["hypotheses"].count() == 1
    bad = insights.insight_job(docs, news, *empty.values(), lambda p: p.select("run_id", F.lit("no").alias("raw")), "r3", "t")
    assert bad["run"].first()["error"] == "no reply with hypotheses" and bad["processed"].count() == 0


def test_prefetch_and_summaries(spark):
    c = spark.createDataFrame([(0, "u0", 0.9, ""), (1, "u1", 0.4, ""), (2, "u2", 0.9, "y" * 300), (3, "u3", 0.6, "")], "seq long, url string, trust_score double, article_text string")
    f = spark.createDataFrame([("u0", None, None, "s" * 300, "p" * 250), ("u1", None, None, "s" * 300, "p" * 250), ("u3", None, None, "s" * 300, None)], "url string, direct string, page string, snippets string, paid string")
    out, modes = flows.prefetch(c, f)
    assert sorted(rows(out.withColumn("t", F.left("article_text", F.lit(1))), "seq", "t")) == [(0, "p"), (1, "s"), (2, "y"), (3, "s")]
    assert dict(rows(modes, "mode", "n")) == {"paid": 1, "snippets": 2}
    items = out.withColumn("title", F.lit("t")).withColumn("summary_ru", F.when(F.col("seq") == 2, "has one").otherwise(""))
    done = flows.summarised(items, f.select("url", "direct", "paid"), lambda r: r.select("id", F.rpad("title", 220, "z").alias("summary")))
    assert dict(rows(done.withColumn("n", F.length("summary_ru")), "seq", "n")) == {0: 220, 1: 220, 2: 7, 3: 220}


def test_documents_of_the_desk(spark):
    files = spark.createDataFrame([("/x/a.txt", "txt", "hello there")], "path string, ext string, content string")
    doc = documents.uploaded(files, "me", "t", " a, ,b ").first()
    assert (doc["title"], doc["tags"], doc["moderation_status"], doc["source_type"]) == ("a.txt", "a,b", "approved", "file")
    docs = spark.createDataFrame([("1", "see http://a.b/x and http://a.b/y", "approved", "done", "", ""), ("2", "none", "pending", "done", "t1, t2", "")], "id string, content string, moderation_status string, enrichment_status string, tags string, auto_tags string")
    pages = spark.createDataFrame([("http://a.b/y", "the page")], "url string, text string")
    assert dict(rows(documents.with_linked(docs, pages), "id", "content")) == {"1": "see http://a.b/x and http://a.b/y\n\nhttp://a.b/y\nthe page", "2": "none"}
    asked = spark.createDataFrame([("1",), ("2",)], "id string")
    assert dict(rows(documents.again(docs, asked), "id", "enrichment_status")) == {"1": "pending", "2": "done"}
    assert documents.presented(docs).where("id = '2'").first()["tags"] == ["t1", "t2"]
    ev = spark.createDataFrame([("h", "1"), ("h", "2")], "hypothesis_id string, doc_id string")
    kept, left = documents.deleted(docs, ev, spark.createDataFrame([("1",)], "id string"))
    assert rows(kept, "id") == [("2",)] and rows(left, "doc_id") == [("2",)]
    full = schemas.migrate(docs, "kb_docs")
    replies = spark.createDataFrame([("1", "short", "sum", "#A,b", None), ("2", None, None, None, "boom")], "id string, tldr string, summary_md string, tags string, error string")
    assert sorted(rows(documents.enriched(full, replies), "id", "tldr", "auto_tags", "enrichment_status", "enrichment_error")) == [("1", "short", "a,b", "done", ""), ("2", None, "", "error", "boom")]
    who = spark.createDataFrame([(True, ["x"], False), (False, ["kb"], True), (None, None, None)], "is_admin boolean, sections array<string>, moderator boolean")
    assert rows(documents.can(who), "can_read", "can_upload", "can_moderate") == [(True, True, True), (True, True, True), (False, False, False)]


def test_views(spark):
    h = spark.createDataFrame([("a", "Travel", 1, 1, "archived", None), ("b", "Travel", 0, 1, None, "news"), ("c", "UX/UI", 1, 3, "validated", "")], "id string, category string, validated int, evidence_count long, lifecycle_status string, source_kind string")
    assert rows(insights.filtered(h, True), "id") == [("a",)] and sorted(rows(insights.filtered(h), "id")) == [("b",), ("c",)]
    assert rows(insights.filtered(h, view="single"), "id") == [("b",)] and rows(insights.filtered(h, kind="material"), "id") == [("c",)]
    assert insights.header(h).first().asDict() == {"total": 3, "validated": 2, "single": 2, "asis": 2, "archive": 1}
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "a string, b string, w int")
    assert rows(insights.visible_edges(edges, h.where("id <> 'b'")), "b") == [("c",)]
    done = insights.mark_processed(schemas.empty(spark, "kb_insight_docs"), spark.createDataFrame([("x",), ("x",)], "doc_id string"), "r", "t")
    assert rows(done, "doc_id", "first_run_id") == [("x", "r")]


def test_reader_detail(spark):
    e = [(1, "h", "me", "react", "like"), (2, "h", "b", "react", "like"), (3, "h", "a", "react", "dislike"), (4, "h", "me", "note", " n "), (5, "h", "me", "bookmark", None), (6, "h", "me", "chat", "hi"), (7, "h", "b", "chat", "yo"), (8, "x", "me", "react", "like"), (9, "h", "b", "clear_chat", None)]
    got = state.detail(spark.createDataFrame(e, "seq long, article_hash string, user string, kind string, value string"), "h", "me").first()
    assert got.asDict() == {"likes": 2, "dislikes": 1, "my_reaction": "like", "likers_other": ["b"], "dislikers_other": ["a"], "bookmarked": True, "bookmark_total": 1, "my_note": "n", "my_chat_msgs": 1, "team_chat_active": 1}


def test_small_functions(spark):
    one = spark.createDataFrame([("2026-05-07T10:00:00 junk", "тревел", "abcdef")], "t string, q string, s string")
    r = one.select(scores.parse_loose(F.col("t")).cast("string").alias("t"), urls.search_feed(F.col("q")).alias("f"), text.shorten(F.col("s"), 3).alias("s"), text.search_terms(F.lit("a b-c")).alias("w"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j")).first()
    assert tuple(r) == ("2026-05-07 10:00:00", "ru", "abc…", ["a", "b-c"], 0.5)
    df = spark.createDataFrame([("k", "v", "text"), ("k", "w", " ")], "a string, b string, text string")
    assert readers.lookup(df, a="k").count() == 1 and readers.lookup(df, a="k", b="w").count() == 0
    docs = spark.createDataFrame([("",), ("pending",)], "moderation_status string")
    assert sorted(rows(schemas.backfill_moderation(docs), "moderation_status")) == [("approved",), ("pending",)]
    t = schemas.migrate(spark.createDataFrame([("1", "k", "error", 1, "basic", 5), ("2", "k", "queued", 0, "basic", 6)], "id string, kind string, status string, attempts int, tier string, priority long"), "jobs")
    t = t.withColumn("transient", F.col("id") == "1")
    assert sorted(rows(jobs.retried(t, 1000), "id", "status", "attempts", "priority"), key=str)[0] == ("1", "queued", 2, 20000000091000)
    assert rows(jobs.find_active(t, "k"), "id") == [("2",)] and {k: v.count() for k, v in jobs.admin_list(t).items()} == {"queued": 1, "running": 0, "recent": 1}


def test_routed_texts(spark):
    long = "news of the day " * 20
    rows = [
        ("https://www.bank.test/a", long, "proxied", "plain"),
        ("https://www.bank.test/a", "short", "proxied", "plain"),
        ("https://bank.test/a", "Just a moment... " + long, "proxied", "plain"),
        ("https://notbank.test/a", None, "proxied", "plain"),
        ("https://other.test/a", None, "proxied", "please verify that you are no robot"),
        ("https://bank.test/a", "", None, "plain"),
        ("", long, "proxied", "plain"),
        (None, long, "proxied", "plain"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, extracted string, proxied string, plain string")
    got = {r["i"]: (r["tier"], r["fetched_text"]) for r in documents.routed(df, r"(^|\.)bank\.test$", cut=40).collect()}
    assert got == {0: ("extracted", long[:40]), 1: ("proxied", "proxied"), 2: ("proxied", "proxied"), 3: ("plain", "plain"), 4: ("plain", ""), 5: ("proxied", ""), 6: ("none", ""), 7: ("none", "")}
    assert documents.routed(df.limit(0), "x").count() == 0


def test_message_names_its_language(spark):
    df = spark.createDataFrame([("a",), (None,)], "m string").select(text.in_language(F.col("m")).alias("m"), text.scrub_reply(text.in_language(F.col("m"))).alias("clean"))
    rows = df.collect()
    assert rows[0]["m"].startswith("a\n\n[") and rows[0]["m"][1:] == rows[1]["m"]
    assert rows[0]["clean"] == "a"  # an echo of the rule is scrubbed
