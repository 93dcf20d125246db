"""Operators against plain loops and hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwire.operators import archive, dedupe, documents, insights, jobs, search, state, windows
from sparkwire.sources import schemas


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def test_round_robin_is_the_loop(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", "c", "", None])) for i in range(120)]
    by, want = {}, []
    for i, s in data:
        by.setdefault(s or "_", []).append(i)
    while len(want) < 50 and any(by.values()):
        for s in list(by):
            if by[s] and len(want) < 50:
                want.append(by[s].pop(0))
    df = spark.createDataFrame(data, "seq int, source string")
    assert [r["seq"] for r in windows.round_robin(df, 50).collect()] == want


def test_host_cap(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate("aaabc")], "seq int, host string")
    assert [x for x, in rows(windows.host_cap(df, "host", 2, 3), "host")] == ["a", "a", "b"]


def test_breaker(spark):
    n = [0] * 24 + [1] + [0] * 25 + [1, 0]
    df = spark.createDataFrame(list(enumerate(n)), "seq int, n int")
    assert windows.until_breaker(df, F.col("n") == 0, 25).count() == 50


def test_queue_position_counts_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "id string, priority long")
    assert dict(rows(windows.queue_position(df), "id", "queue_pos")) == {"a": 1, "b": 3, "c": 3, "d": 4}


def test_best_snippets(spark):
    df = spark.createDataFrame([(0, "k", "x" * 40), (1, "k", "X" * 40), (2, "k", "y" * 700), (3, "k", "short")], "seq int, key string, text string")
    assert sorted(rows(windows.best_snippets(df, ["key"]).withColumn("n", F.length("text")), "seq", "n")) == [(0, 40), (2, 600)]


WORDS = [f"w{chr(97 + k)}" for k in range(14)]


def collapse_loop(items):
    """(seq, collected, words) -> leader by seq."""
    kept, out = [], {}
    for seq, at, words in sorted(items, key=lambda x: (x[1], x[0])):
        lead = None
        for k_seq, k_at, k_words in kept:
            old = bool(at) and bool(k_at) and int(k_at[8:10]) < int(at[8:10]) - 5
            if words and k_words and not old and 10 * len(words & k_words) >= 7 * len(words | k_words):
                lead = k_seq
                break
        out[seq] = lead
        if lead is None:
            kept.append((seq, at, words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_is_the_loop(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice(["", "2026-05-01T00:00:00Z", "2026-05-03T00:00:00Z", "2026-05-09T00:00:00Z"]), set(rng.sample(WORDS, rng.randint(0, 7)))) for i in range(150)]
    df = spark.createDataFrame([(i, " ".join(sorted(w)), at, f"http://s/{i}", "s", 0.5) for i, at, w in items], "seq long, title string, collected_at string, url string, source string, trust_score double")
    want = collapse_loop(items)
    got = {r["seq"]: [int(d["url"].rpartition("/")[2]) for d in r["dup_sources"]] for r in dedupe.collapse(df).collect()}
    assert set(got) == {s for s, lead in want.items() if lead is None}
    for s, dups in got.items():
        assert set(dups) == {k for k, lead in want.items() if lead == s}


def test_collapse_is_not_transitive_and_window_is_inclusive(spark):
    a, b, c = "aa bb cc dd ee ff", "aa bb cc dd ee ff gg", "bb cc dd ee ff gg hh"
    make = lambda data: spark.createDataFrame([(i, t, at, f"u{i}", "s", 0.5) for i, (t, at) in enumerate(data)], "seq long, title string, collected_at string, url string, source string, trust_score double")
    assert [r["seq"] for r in dedupe.collapse(make([(a, "x"), (b, "x"), (c, "x")])).orderBy("seq").collect()] == [0, 2]
    near = make([(a, "2026-05-01T00:00:00Z"), (a, "2026-05-06T00:00:00Z")])
    far = make([(a, "2026-05-01T00:00:00Z"), (a, "2026-05-06T00:00:01Z")])
    assert (dedupe.collapse(near).count(), dedupe.collapse(far).count()) == (1, 2)


def test_merge_candidates(spark):
    kind = "seq long, url string, article_text string, trust_score double"
    old = spark.createDataFrame([(0, "http://a.b/1", "x" * 900, 0.5)], kind)
    new = spark.createDataFrame([(0, "http://a.b/1#f", "", 1.0), (1, "http://a.b/2", "yy", 0.5), (2, "http://a.b/2?utm_x=1", "zzz", 0.9), (3, "http://a.b/3", None, None)], kind)
    got = rows(archive.merge_candidates(old, new).withColumn("n", F.length("article_text")), "url", "n")
    assert got == [("http://a.b/1", 800), ("http://a.b/2", 2), ("http://a.b/3", None)]


def _item(spark, data):
    kind = "seq long, article_hash string, title string, url string, source string, trust_score double, collected_at string, summary_ru string"
    return spark.createDataFrame([(i, h, t, f"http://s/{h}", "s", 0.5, at, s) for i, (h, t, at, s) in enumerate(data)], kind).withColumn("dup_sources", F.array().cast(dedupe.REF))


def test_upsert_archive(spark):
    t = "aa bb cc dd ee ff"
    old = _item(spark, [("h1", t, "2026-05-01T00:00:00Z", ""), ("h2", "zz yy xx", "2026-05-02T00:00:00Z", "kept")])
    new = _item(spark, [("h1", t, "2026-05-03T00:00:00Z", "new summary"), ("h2", "zz yy xx", "2026-05-03T00:00:00Z", "other"), ("h3", t + " gg", "2026-05-03T00:00:00Z", ""), ("h4", "qq rr ss", "2026-05-03T00:00:00Z", ""), ("h5", "qq rr ss", "2026-05-03T00:00:00Z", "")])
    got = {r["article_hash"]: r for r in archive.upsert(old, new, "2026-05-03T00:00:00Z").collect()}
    assert set(got) == {"h1", "h2", "h4"}
    assert got["h1"]["summary_ru"] == "new summary" and got["h2"]["summary_ru"] == "kept"
    assert [d["url"] for d in got["h1"]["dup_sources"]] == ["http://s/h3"]
    assert [d["url"] for d in got["h4"]["dup_sources"]] == ["http://s/h5"]
    again = archive.upsert(archive.upsert(old, new, "2026-05-03T00:00:00Z"), new, "2026-05-03T00:00:00Z")
    assert {r["article_hash"]: len(r["dup_sources"]) for r in again.collect()} == {k: len(v["dup_sources"]) for k, v in got.items()}


def test_story_groups(spark):
    df = _item(spark, [("a", "x", "", ""), ("b", "y", "", ""), ("c", "z", "", "")]).withColumn("trust_score", F.col("seq").cast("double")).withColumn("story_group", F.when(F.col("seq") > 0, "g"))
    got = {r["article_hash"]: [d["url"] for d in r["dup_sources"]] for r in dedupe.story_groups(df).collect()}
    assert got == {"a": [], "c": ["http://s/b"]}


def test_packages(spark):
    old = schemas.empty(spark, "archive").select("seq", "article_hash", "title", "url", "source", "trust_score", "collected_at", "dup_sources").withColumn("posted_at", F.lit(""))
    item = "array<struct<title:string,url:string,posted_at:string>>"
    runs = spark.createDataFrame([(0, 1_000_000_000_000, [("old", "http://t.me/a/1", "")]), (1, 1_700_000_000_000, [("one two three", "http://t.me/a/2", "10:00"), ("one two three", "http://t.me/a/2", ""), ("one two three", "http://t.me/b/3", "")])], f"seq long, run_ms long, items {item}")
    got = archive.packages(old, runs, 1_700_000_000_000).collect()
    assert [(r["url"], r["source"], len(r["dup_sources"])) for r in got] == [("http://t.me/a/2", "@a", 0)]


def _hyp(spark, data):
    return schemas.migrate(spark.createDataFrame(data, "id string, statement string, category string, lifecycle_status string, evidence_count long, created_at string"), "kb_hypotheses")


def test_store_validates_and_merges(spark):
    old = _hyp(spark, [("p", "alpha beta gamma delta", "Travel", "in_review", 1, "1"), ("s", "other", "Travel", "synthesized", 1, "2")])
    evidence = spark.createDataFrame([("p", "d1", "", 1), ("s", "d1", "", 1)], schemas.SCHEMAS["kb_hypothesis_sources"])
    reply = """text {"hypotheses": [
      {"statement": "alpha beta gamma delta", "category": "travel", "confidence": 0.95, "sources": [{"doc_id": "d1"}, {"doc_id": "news:a", "is_origin": true}]},
      {"statement": "new one here", "category": "UX-UI", "confidence": "1.7", "sources": [{"doc_id": "news:a"}, {"doc_id": "news:a"}, {"doc_id": "bad"}]},
      {"statement": "no sources", "category": "ux", "confidence": 1, "sources": [{"doc_id": "bad"}]},
      {"statement": "no category", "category": "zzz", "confidence": 1, "sources": [{"doc_id": "d1"}]}]}"""
    replies = spark.createDataFrame([("r1", reply)], "run_id string, raw string")
    valid = spark.createDataFrame([("d1",), ("news:a",)], "id string")
    hyps, ev = insights.store(old, evidence, replies, valid, "3", append=False)
    got = {r["statement"]: r for r in hyps.collect()}
    assert set(got) == {"alpha beta gamma delta", "new one here"}
    assert got["alpha beta gamma delta"]["evidence_count"] == 2 and got["alpha beta gamma delta"]["lifecycle_status"] == "in_review"
    new = got["new one here"]
    assert (new["confidence"], new["validated"], new["evidence_count"], new["source_kind"], new["category"], new["lifecycle_status"]) == (1.0, 1, 1, "news", "UX/UI", "synthesized")
    assert sorted(rows(ev, "doc_id")) == [("d1",), ("news:a",), ("news:a",)]
    kept, _ = insights.store(old, evidence, replies, valid, "3", append=True)
    assert kept.count() == 3


def test_graph(spark):
    df = spark.createDataFrame([("h1", "d1"), ("h1", "d2"), ("h1", "d3"), ("h2", "d2"), ("h2", "d3"), ("h3", "d9")], "hypothesis_id string, doc_id string")
    assert rows(insights.graph(df), "a", "b", "w") == [("h1", "h2", 2)]


def test_badge_mine_and_detail(spark):
    kind = "id string, owner_username string, lifecycle_status string, next_check_at string, created_at string"
    df = spark.createDataFrame([("h1", "me", "in_review", None, "1"), ("h2", "Me", "in_review", "2026-01-01", "2"), ("h3", "me", "adopted", "2026-01-01", "3"), ("h4", "you", "in_review", None, "4")], kind)
    assert insights.badge(df, "ME", "2026-01-02").first()["n"] == 3
    assert [r["id"] for r in insights.mine(df, "me", "2026-01-02T00:00:00").collect()] == ["h2", "h3", "h1"]
    ev = spark.createDataFrame([("h1", "d1", "x", 0), ("h1", "news:n", "y", 1), ("h1", "gone", "z", 0)], schemas.SCHEMAS["kb_hypothesis_sources"])
    docs = spark.createDataFrame([("d1", "T", "file", "", "x" * 300)], "id string, title string, source_type string, source_ref string, content string")
    news = spark.createDataFrame([("news:n", "N", "http://n")], "id string, title string, url string")
    hyps = df.withColumn("statement", F.lit("s"))
    assert rows(insights.detail("h1", hyps, ev, docs, news), "doc_id", "quality") == [("news:n", "amber"), ("d1", "green"), ("gone", "red")]


def test_prompt_and_unprocessed(spark):
    df = spark.createDataFrame([(0, "a", "T", "", "x", "body", None), (1, "b", "U", "http://r", "", "more", "news")], "seq long, id string, title string, source_ref string, tags string, content string, kind string")
    got = insights.prompt(df, "HEAD").first()["prompt"]
    assert got == "HEAD\n--- DOC id=a | kind=material | title=T | tags=x ---\nbody\n--- DOC id=b | kind=news | title=U | source=http://r ---\nmore"
    done = spark.createDataFrame([("a",)], "doc_id string")
    assert insights.unprocessed(df, done, [F.col("seq")], 1).count() == 0


@pytest.mark.parametrize(
    "status, to, owner, confirm, result",
    [
        ("synthesized", "validated", "x", False, "transition_not_allowed"),
        ("synthesized", "in_review", None, False, "ok"),
        ("in_review", "validated", None, False, "assign_owner_first"),
        ("validated", "adopted", "x", False, "ok"),
        ("adopted", "archived", "x", False, "confirm_required"),
        ("archived", "synthesized", None, False, "ok"),
        ("adopted", "adopted", None, False, "unchanged"),
    ],
)
def test_lifecycle(spark, status, to, owner, confirm, result):
    current = spark.createDataFrame([("h", status, owner, None)], "id string, lifecycle_status string, owner_username string, next_check_at string")
    one = spark.createDataFrame([("h", to, "me", confirm)], "id string, to string, caller string, confirm boolean")
    got = state.checked(one, current).first()
    assert got["result"] == result and got["owner_username"] == ("me" if to == "in_review" else owner)
    events = spark.createDataFrame([("h", 1, "transition", to, "me", False, confirm)], "id string, seq long, kind string, value string, caller string, is_admin boolean, confirm boolean")
    assert state.fold(current, events).first()["result"] == result


def test_fold_owner_and_check(spark):
    current = spark.createDataFrame([("h", "in_review", None, None)], "id string, lifecycle_status string, owner_username string, next_check_at string")
    data = [(1, "owner", "you", "me", False), (2, "owner", "me", "me", False), (3, "owner", "z", "z", False), (4, "next_check", "2026-13-01", "me", False), (5, "next_check", "2026-01-02", "me", False), (6, "owner", "z", "adm", True)]
    events = spark.createDataFrame([("h", s, k, v, c, a, False) for s, k, v, c, a in data], "id string, seq long, kind string, value string, caller string, is_admin boolean, confirm boolean")
    folded = state.fold(current, events)
    assert [r["result"] for r in folded.orderBy("seq").collect()] == ["forbidden", "ok", "already_owned", "bad_date", "ok", "ok"]
    assert rows(state.latest_state(folded), "owner_username", "next_check_at") == [("z", "2026-01-02")]


def _events(spark, data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "seq long, article_hash string, user string, kind string, value string")


def test_reader_state(spark):
    e = _events(spark, [("a", "u", "react", "like"), ("a", "v", "react", "like"), ("a", "u", "react", "dislike"), ("b", "u", "react", "like"), ("b", "u", "react", "clear"), ("a", "u", "bookmark", None), ("a", "u", "bookmark", None), ("a", "u", "bookmark", None), ("c", "u", "note", " n "), ("d", "u", "note", "n"), ("d", "u", "note", " ")])
    got = {r["article_hash"]: r for r in state.feed(e, "u").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"]["likes"], got["a"]["dislikes"], got["a"]["my"], got["a"]["bookmarked"], got["a"]["top_reactors"]) == (1, 1, "dislike", True, ["v"])
    assert (got["b"]["likes"], got["b"]["my"], got["c"]["has_note"], got["d"]["has_note"]) == (0, None, True, False)


def test_chat_and_preferences(spark):
    e = _events(spark, [("a", "u", "chat", "old"), ("a", "u", "clear_chat", None), *[("a", "u", "chat", f"m{k}") for k in range(31)], ("a", "u", "chat", " ")])
    got = state.chats(e)
    assert got.count() == 30 and got.where("value = 'm0'").count() == 0
    p = spark.createDataFrame([(1, "u", "theme=dark"), (2, "u", "theme=light"), (3, "u", "bad=x")], "seq long, user string, value string")
    assert state.preferences(p).first()["prefs"] == {"theme": "light"}


def _jobs(spark, data):
    return schemas.migrate(spark.createDataFrame(data, "id string, kind string, tier string, status string, submitted_at string, started_at string, finished_at string, attempts int, priority long"), "jobs")


def test_jobs(spark):
    t = "2026-01-01T00:00:"
    data = [(str(k), "k", "basic", "done", t + "00", t + f"{k:02d}", t + f"{2 * k:02d}", 0, k) for k in range(1, 5)] + [("e", "k", "basic", "error", t + "00", None, None, 0, 9), ("r", "k", "admin", "running", t + "00", t + "05", None, 0, 8)]
    df = _jobs(spark, data)
    m = {(r["dimension"], r["name"]): r for r in jobs.metrics(df).collect()}[("tier", "basic")]
    assert (m["count"], m["done"], m["errors"], m["error_rate"], m["p50_duration_s"], m["p95_duration_s"], m["avg_duration_s"]) == (5, 4, 1, 0.2, 3, 4, 2)
    assert jobs.status(df, "r", t + "15").first()["elapsed_s"] == 10
    kinds = spark.createDataFrame([("k", True, False)], "kind string, recover boolean, serial boolean")
    assert jobs.recovered(df, kinds, t + "20").where("id = 'r'").first()["status"] == "queued"
    kept, events = jobs.cleaned(df, spark.createDataFrame([("1",), ("r",)], "job_id string"), "2026-03-01T00:00:00")
    assert sorted(x for x, in rows(kept, "id")) == ["e", "r"] and events.count() == 1


def test_search(spark):
    df = spark.createDataFrame([("1", "Онбординг карта", "", "approved", "a"), ("2", "онбординг", "карты и ещё", "approved", "a"), ("3", "карта", "", "approved", "a"), ("4", "онбординг карта", "", "pending", "b")], "id string, title string, content string, moderation_status string, author string")
    vis = documents.visible("a", False)
    assert {r["id"] for r in search.search(df, "id", ["title", "content"], "онб карт", visible=vis).collect()} == {"1", "2"}
    assert search.search(df, "id", ["title"], "  ").count() == 0
    s = df.select(search.snippet(F.col("title"), ["карт"]).alias("s")).first()["s"]
    assert s == "Онбординг <mark>карта</mark>"
    postings, lengths = search.index(df, "id", ["title", "content"])
    assert postings.where("term = 'карта'").count() == 3 and lengths.count() == 4


def test_documents(spark):
    new = spark.createDataFrame([("", "first line\nmore", "a", False)], "title string, content string, author string, is_moderator boolean")
    doc = documents.inserted(new, "t").first()
    assert (doc["title"], doc["moderation_status"]) == ("first line", "pending")
    got = documents.fetched(spark.createDataFrame([("x" * 10, "y" * 300, 0.4)], "a string, paid string, trust_score double"), [("a", "t1", 200), ("paid", "paid", 200)]).first()
    assert (got["text"], got["mode"]) == ("", "thin")
    health = spark.createDataFrame([("m", "1", "bad"), ("m", "2", "ok")], "mode string, finished_at string, status string")
    assert rows(documents.latest_health(health), "status") == [("ok",)]


def test_schema_backfills(spark):
    ev = spark.createDataFrame([("h", "d1", "", 0), ("h", "d2", "", 0)], schemas.SCHEMAS["kb_hypothesis_sources"])
    done = spark.createDataFrame([("d1", "r", "t")], schemas.SCHEMAS["kb_insight_docs"])
    assert sorted(rows(schemas.backfill_processed(done, ev, "now"), "doc_id", "first_run_id")) == [("d1", "r"), ("d2", "legacy")]
    hyp = schemas.migrate(spark.createDataFrame([("h", 1)], "id string, validated int"), "kb_hypotheses")
    assert schemas.backfill_lifecycle(hyp).first()["lifecycle_status"] == "validated"
