"""Phrases, tiers, summaries of every item, listing selectors, and near-duplicates of many postings."""

import io
import random
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.functions import text
from sparkwire.operators.graph import components
from sparkwire.operators import archive, dedupe, documents, insights, kept, search
from sparkwire.plans import flows
from sparkwire.plans import queries as plans
from sparkwire.session import checkpoint
from sparkwire.sources import listing, office, readers
from sparkwire.streaming import incremental


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---- phrases


@pytest.mark.parametrize("query,want", [("e-mail", {1, 4, 6}), ("e mail", {1, 2, 3, 4, 5, 6}), ("state-of-the-art", {7}), ("of-the", {7, 8}), ("a-a", {9}), ("card-e", set()), ("- e-mai", {1, 4, 6}), ("b_c", {10})])
def test_phrases(spark, query, want):
    df = spark.createDataFrame(
        [(1, "an e-mail box", ""), (2, "mail e box", ""), (3, "e", "mail"), (4, "x", "my E mailing"), (5, "e box mail", ""), (6, "e-mail e-mail", "e mail"), (7, "State of the art", ""), (8, "of them", ""), (9, "a b a a a", ""), (10, "b c", "")],
        "id long, title string, content string",
    )
    scan = rows(search.search(df, "id", ["title", "content"], query), "id", "score")
    index = rows(search.search_index(*search.index(df, "id", ["title", "content"]), query), "id", "score")
    assert {i for i, _ in scan} == want
    assert [i for i, _ in scan] == [i for i, _ in index] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(scan, index, strict=True))


def test_index_by_loops(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["aa", "ab", "ba", "c"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    df = spark.createDataFrame(texts, "id long, text string")
    postings, lengths = search.index(df, "id", ["text"])
    for query in ("aa-b", "c-aa-a", "a-a"):
        parts = query.split("-")
        n = len(parts)
        want = set()
        for k, t in texts:
            w = t.split()
            if any(w[i : i + n - 1] == parts[:-1] and w[i + n - 1].startswith(parts[-1]) for i in range(len(w) - n + 1)):
                want.add(k)
        assert {i for i, _ in rows(search.search_index(postings, lengths, query, 100), "id", "score")} == want


@pytest.mark.parametrize("name", ["phrase_search", "fts_search_bm25"])
def test_scores_that_round_alike_are_in_order_of_id(spark, tmp_path, name):
    """Every document has the terms, so that scores are some millionths: the longer text comes first where ids say so."""
    import duckdb

    docs = [(k, "of the on there " * 3 + "x " * (9 - k), "en", "web") for k in range(1, 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    function, sql = plans.QUERIES[name]
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in function(spark, str(tmp_path)).collect()] == db.execute(sql).fetchall()


def test_snippet_marks_phrases(spark):
    one = spark.createDataFrame([("send an e-mail or e mail now mail",)], "t string")
    assert one.select(search.snippet(F.col("t"), ["e-mail"]).alias("s")).first()["s"] == "send an <mark>e-mail</mark> or <mark>e</mark> mail now mail"


# ---- tiers and summaries


def test_no_tier_takes_a_block_page(spark):
    block = f"{P.BLOCK_MARKERS[0]} " + "x" * 400
    good, thin = "g" * 400, "t" * 250
    data = [
        ("a", block, None, None, None, None, None, 0.9), ("b", block, block, good, None, None, None, 0.9), ("c", block, block, block, "s" * 900, None, None, 0.9),
        ("d", None, None, None, "s" * 300, good, None, 0.9), ("e", None, None, None, "s" * 300, block, None, 0.9), ("f", thin, None, None, None, None, good, 0.1), ("g", thin, None, None, None, None, block, 0.1),
    ]
    df = spark.createDataFrame(data, "url string, direct string, page string, plain string, snippets string, paid string, agent string, trust_score double")
    got = {u: (t[:1], m) for u, t, m in rows(documents.fetched(df, documents.PREFETCH), "url", "text", "mode")}
    assert got == {"a": ("", "thin"), "b": ("g", "plain"), "c": ("s", "snippets"), "d": ("g", "paid"), "e": ("s", "snippets"), "f": ("t", "direct"), "g": ("t", "direct")}
    got = {u: (t[:1], m) for u, t, m in rows(documents.rescued(df), "url", "text", "mode")}
    assert got["f"] == ("g", "agent") and got["g"] == ("", "direct->thin") and got["a"] == ("", "thin->thin") and got["b"] == ("g", "plain")


def test_every_item_is_summarised(spark):
    """Forty items, of which twenty can be fetched and five have a summary: the limit of 35 is one on fetching only."""
    items = [(k, f"u{k}" if k != 7 else None, f"title {k}", "own " * 900 if k == 8 else "", "done" if k % 8 == 0 and k != 8 else "", k / 40, "why" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(items, "seq long, url string, title string, article_text string, summary_ru string, trust_score double, relevance_reason string")
    fetched = spark.createDataFrame([(f"u{k}", "d" * 3000) for k in range(20)], "url string, direct string")
    batch = {r["id"]: r for r in flows.summary_batch(df, fetched, most=35).collect()}
    lacking = {k for k, *_, s, _, _ in items if not s}
    assert set(batch) == lacking and len(lacking) == 36
    skipped = min(lacking, key=lambda k: items[k][5])  # the 36th by trust is not fetched
    assert batch[skipped]["mode"] == "fallback" and batch[7]["text"] == "title 7. why" and batch[38]["text"] == "title 38"
    assert batch[8]["mode"] == "own" and len(batch[8]["text"]) == 2500 and batch[19]["text"] == "d" * 2500
    done = flows.summarised(df, fetched, lambda r: r.select("id", F.rpad("text", 300, ".").alias("summary")))
    assert not [s for s, in rows(done, "summary_ru") if not s] and done.count() == 40


# ---- listings


def test_selectors():
    html = """<a class="x news-card" href="/1">A <b>bold</b>&nbsp;label</a><a href='/2' class=y>two<a href="/3/news/lenta/4">three<script>no</script> <i>in</i></a>
    <div class=news-card>no link</div><a>none</a><A HREF="/5?news/"><span>five</span>"""
    assert listing.links(html, "a.news-card") == [("/1", "A bold label")]
    assert listing.links(html) == [("/1", "A bold label"), ("/2", "two"), ("/3/news/lenta/4", "three in"), ("/5?news/", "five")]
    assert [h for h, _ in listing.links(html, "a[href*='/news/'][href*='/lenta/'], a[class='y']")] == ["/2", "/3/news/lenta/4"]
    assert [h for h, _ in listing.links(html, "[href$='4'], a[href^=\"/5\"]")] == ["/3/news/lenta/4", "/5?news/"]
    assert [h for h, _ in listing.links(html, "a[class~='news-card'],a[class|=y]")] == ["/1", "/2"]
    assert all(listing.compiled(s) for s in listing.SELECTORS.values()) and listing.links(None) == []
    for bad in ("a b", "a >b", "", "a,"):
        with pytest.raises(ValueError):
            listing.compiled(bad)


def test_listing_links(spark):
    label = "a label of some length"
    html = "".join(f'<a class="{c}" href="{h}">{label[:5]}<b>{label[5:]}</b> {k}</a>' for k, (h, c) in enumerate([
        ("/news/author/jane-writes", "n"), ("/login/", "n"), ("/news/tag", "n"), ("/news/one", "n"), ("/news/one", "n"), ("//site.com/two", "m"), ("https://sub.site.com/three", "n"),
        ("https://other.com/x", "n"), ("four", "n"), ("/RSS", "n"), ("/page/2", "n"), ("/about/contact/", "n")]))
    pages = spark.createDataFrame([("http://www.site.com/list", html + '<a href="/s">short</a>'), ("http://none.com", None)], "url string, html string")
    assert rows(readers.listing_links(pages).orderBy("pos"), "href") == [(x,) for x in ("http://www.site.com/news/author/jane-writes", "http://www.site.com/news/one", "http://site.com/two", "https://sub.site.com/three", "http://www.site.com/page/2")]
    assert rows(readers.listing_links(pages, selectors={"site.com": "a.m"}), "href", "label") == [("http://site.com/two", f"{label[:5]} {label[5:]} 5")]
    assert len(rows(readers.listing_links(pages, most=2), "href")) == 2


# ---- near-duplicates


def plain_collapse(items):
    """(collected_at, seq, words) -> seq: leader's seq or None, one at a time."""
    kept, out = [], {}
    for at, seq, words in sorted(items, key=lambda x: (x[0] or "", x[1])):
        time = datetime.fromisoformat(at) if at else None
        out[seq] = None
        if not words:
            kept.append((time, seq, words))
            continue
        for t, s, w in kept:
            if w and len(words & w) / len(words | w) >= 0.7 and not (time and t and t < time - timedelta(days=5)):
                out[seq] = s
                break
        else:
            kept.append((time, seq, words))
    return out


@pytest.mark.parametrize("most_links", [1 << 20, 0])
def test_leaders_equal_one_at_a_time(spark, most_links):
    rng = random.Random(17)
    words = [f"word{k}" for k in range(14)]
    items = []
    for k in range(220):
        title = " ".join(rng.sample(words[:9] if k % 3 else words, rng.choice([4, 5, 6, 7])))
        at = (datetime(2026, 1, 1) + timedelta(hours=rng.randint(0, 24 * 30))).isoformat() if rng.random() > 0.1 else ""
        items.append((k, title if rng.random() > 0.03 else "", at))
    df = spark.createDataFrame(items, "seq long, title string, collected_at string").withColumn("__key", F.struct("collected_at", "seq"))
    lead = dedupe.leaders(df, "title", "__key", most_links=most_links)
    got = {r["pos"]["seq"]: r["leader"] and r["leader"]["seq"] for r in lead.collect()}
    assert got == plain_collapse([(at, k, set(t.split())) for k, t, at in items])
    assert sum(v is not None for v in got.values()) > 30


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_components(spark, few):
    rng = random.Random(2)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in [*[(k, k + 1) for k in range(60)], *[(rng.randint(70, 199), rng.randint(70, 199)) for _ in range(90)]] if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in edges]], "a string, b string")
    assert dict(rows(components(df, few), "node", "root")) == {x: find(x) for x in parent}
    assert components(df.limit(0), few).count() == 0


def test_a_title_posted_all_year(spark):
    """100,000 postings of one title over a year make no pairs: one is kept for each five days."""
    start = "timestamp'2026-01-01 00:00:00'"
    df = spark.range(100_000).selectExpr("id seq", "'one title that is posted again and again' title", f"date_format({start} + make_dt_interval(0, 0, 0, id * 315), \"yyyy-MM-dd'T'HH:mm:ss\") collected_at")
    lead = dedupe.leaders(df.withColumn("__key", F.struct("collected_at", "seq")), "title", "__key")
    kept = sorted(s for s, in rows(lead.where("leader is null"), "pos.seq"))
    step = 5 * 86_400 // 315 + 1
    assert kept == list(range(0, 100_000, step))
    late = {s: x for s, x in rows(lead.where("leader is not null"), "pos.seq", "leader.seq")}
    assert all(x == s // step * step for s, x in late.items())


# ---- the kept archive


def _batches(rng, n, each):
    words = [f"word{'x' * (k % 5)}{k}" for k in range(12)]
    start = datetime(2026, 1, 1)
    out = []
    for b in range(n):
        batch = []
        for k in range(each):
            at = (start + timedelta(days=4 * b, hours=rng.randint(0, 90))).strftime("%Y-%m-%dT%H:%M:%SZ") if rng.random() > 0.08 else None
            h = f"h{rng.randint(0, n * each)}"
            batch.append((k, h, " ".join(rng.sample(words, rng.choice([3, 4, 5]))) if rng.random() > 0.05 else "", f"http://s/{h}/{b}", "s", 0.5, at, rng.choice(["", "text"])))
        out.append(batch)
    return out


KEPT = "seq long, article_hash string, title string, url string, source string, trust_score double, collected_at string, summary_ru string"


def test_kept_archive_equals_the_whole(spark, tmp_path):
    rng = random.Random(6)
    first, *batches = [spark.createDataFrame(b, KEPT).withColumn("dup_sources", F.array().cast(dedupe.REF)) for b in _batches(rng, 3, 30)]
    path = str(tmp_path / "kept")
    kept.create(first, path)
    whole = checkpoint(dedupe.collapse(first))
    show = lambda df: sorted((r["seq"], r["article_hash"], r["title"], r["collected_at"], r["summary_ru"], [d["url"] for d in r["dup_sources"]]) for r in df.collect())
    for k, batch in enumerate(batches):
        as_of = f"2026-01-{5 + 4 * k:02}T00:00:00Z"
        done = kept.apply(spark, path, batch, as_of)
        before, whole = whole, checkpoint(archive.upsert(whole, batch, as_of))
        assert show(kept.read(spark, path)) == show(whole)
        assert done["added"] == whole.count() - before.count()
    assert kept.apply(spark, path, batches[-1], as_of)["added"] == 0  # the same batch again; fields may be filled, as its hashes are known now


def test_kept_archive_reads_touched_weeks_only(spark, tmp_path):
    item = lambda n, h, title, at: (n, h, title, f"http://s/{h}", "s", 0.5, at, "")
    make = lambda *data: spark.createDataFrame([item(k, *x) for k, x in enumerate(data, 1)], KEPT).withColumn("dup_sources", F.array().cast(dedupe.REF))
    path = str(tmp_path / "kept")
    kept.create(make(("a", "one old title here", "2025-01-01T00:00:00Z"), ("b", "another title of march", "2026-03-01T00:00:00Z"), ("c", "something without time", "")), path)
    old = [f for f in (tmp_path / "kept").rglob("*.parquet") if "week=2869" in str(f)]
    assert len(old) == 2
    for f in old:  # whoever reads them fails
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink()
    done = kept.apply(spark, path, make(("d", "one old title here", "2026-03-02T00:00:00Z"), ("e", "another title of march", "2026-03-03T00:00:00Z"), ("f", "something without time", "2026-03-03T00:00:00Z")), "")
    assert done["added"] == 1 and done["changed"] == 2 and 2869 not in done["weeks"]


def test_kept_stream(spark, tmp_path):
    rng = random.Random(9)
    batches = _batches(rng, 2, 20)
    path, source = str(tmp_path / "kept"), str(tmp_path / "in")
    none = spark.createDataFrame([], KEPT).withColumn("dup_sources", F.array().cast(dedupe.REF))
    kept.create(none, path)
    whole = none
    for k, b in enumerate(batches):
        df = spark.createDataFrame(b, KEPT)
        df.coalesce(1).write.mode("append").parquet(source)
        incremental.kept_stream(spark.readStream.schema(KEPT).parquet(source), path, str(tmp_path / "ck"), lambda n: "2026-01-20T00:00:00Z").awaitTermination()
        whole = checkpoint(archive.upsert(whole, df, "2026-01-20T00:00:00Z"))
    key = lambda df: sorted(rows(df, "seq", "article_hash"))
    assert key(kept.read(spark, path)) == key(whole)


# ---- replies of any shape, and the evidence graph by classes


def test_envelopes_of_any_shape(spark):
    import json

    cases = [
        ({"result": {"payloads": [{"text": " a "}, {"text": ""}, {"kind": 1}, "free", {"text": "b", "more": [1]}], "meta": {"agentMeta": {"sessionId": "s1", "n": 3}}}, "summary": "no"}, ("a\n\nb", None, "s1")),
        ({"payloads": [{"text": "x"}], "meta": {"agentMeta": {"sessionId": "s2"}}}, ("x", None, "s2")),
        ({"result": {"payloads": "none"}, "summary": "sum", "sessionId": 17}, ("sum", None, "17")),
        ({"result": None, "summary": "sum", "meta": [1, 2]}, ("sum", None, "")),
        ({"result": {"payloads": []}, "x": {"deep": [{"y": None}]}}, ("", "no reply", "")),
    ]
    data = [(k, f"log line\n{json.dumps(c)}") for k, (c, _) in enumerate(cases)] + [(90, "no json"), (91, "{broken"), (92, None), (93, ""), (94, "[1]")]
    df = spark.createDataFrame(data, "k int, raw string").select("k", text.envelope(F.col("raw")).alias("e")).select("k", "e.reply", "e.error", "e.session")
    got = {r["k"]: (r["reply"], r["error"], r["session"]) for r in df.collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    assert all(got[k][:2] == ("", "no reply") and not got[k][2] for k in (90, 91, 93, 94))


def test_one_evaluation(spark):
    """The rating's text and the reply's JSON are worked out once, however many of their fields are read."""
    df = spark.createDataFrame([("t", "b", "c")], "title string, body string, topic string")
    rated = df.select(text.rate(F.col("title"), F.col("body"), F.col("topic")).alias("r")).select("r.summary", "r.rating", "r.signals")
    assert rated._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    reply = df.select(text.envelope(F.col("body")).alias("e")).select("e.reply", "e.error", "e.session")
    plan = reply._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(array(") == 1 and "e#" in plan


def test_graph_classes(spark):
    rng = random.Random(1)
    pairs = [(n, i) for n in range(60) for i in rng.sample(range(8), rng.randint(1, 3))]
    pairs += [(100 + k, i) for k in range(9) for i in (1, 2, 3)] + [(pairs[0])] * 3 + [(None, 1), (5, None)]
    df = spark.createDataFrame(pairs, "hypothesis_id long, doc_id long")
    want = sorted(rows(insights.graph(df.dropna()), "a", "b", "w"))
    classes, links = insights.graph_classes(df)
    members = {}
    for node, cls, n, items in rows(classes, "node", "class_id", "n_nodes", "n_items"):
        members.setdefault(cls, ([], n, items))[0].append(node)
    assert all(len(m) == n and min(m) == cls for cls, (m, n, _) in members.items()) and len(members) < 69
    got = [(min(a, b), max(a, b), w) for x, y, w in rows(links, "a", "b", "w") for a in members[x][0] for b in members[y][0]]
    got += [(a, b, items) for m, _, items in members.values() for a in m for b in m if a < b]
    assert sorted(got) == want
    shown = spark.createDataFrame([(0,), (100,), (999,)], "id long")
    both = {}
    for a, b, w in want:
        both.setdefault(a, []).append((-w, b))
        both.setdefault(b, []).append((-w, a))
    assert sorted(rows(insights.strongest(df, shown, 4), "node", "rank", "other", "w")) == [(n, k, b, -w) for n in (0, 100) for k, (w, b) in enumerate(sorted(both[n])[:4], 1)]


def test_a_crowd_of_like_nodes(spark):
    """100,000 nodes of one item set, and all nodes of one item: no pairs of nodes."""
    df = spark.range(100_000).selectExpr("id hypothesis_id", "explode(array(1L, 2L)) doc_id").union(spark.range(50).selectExpr("id + 200000", "1L"))
    classes, links = insights.graph_classes(df)
    assert rows(links, "a", "b", "w") == [(0, 200_000, 1)] and classes.count() == 100_050


# ---- office files


@pytest.mark.parametrize("block", [3, 1 << 11])
def test_graph_tasks_grow_with_pairs(spark, monkeypatch, block):
    """A shared item of many nodes goes in blocks, pairs go to as many tasks as they fill; null nodes and items make none."""
    monkeypatch.setattr(insights, "BLOCK", block)
    monkeypatch.setattr(insights, "TASK_PAIRS", 20)
    rng = random.Random(4)
    own = {(n, 0) for n in range(20)} | {(rng.randrange(30), rng.randrange(1, 12)) for _ in range(60)}
    want = {}
    for a, i in own:
        for b, j in own:
            if a < b and i == j:
                want[a, b] = want.get((a, b), 0) + 1
    data = [*own, *list(own)[:30], (None, 0), (3, None), (4, None)]
    edges = insights.graph(spark.createDataFrame(data, "hypothesis_id long, doc_id long"))
    assert sorted(rows(edges, "a", "b", "w")) == sorted((a, b, w) for (a, b), w in want.items())
    assert edges.rdd.getNumPartitions() >= sum(want.values()) / 20
    assert insights.graph(spark.createDataFrame([], "hypothesis_id long, doc_id long")).count() == 0


@pytest.mark.parametrize(("light", "block"), [(32, 1 << 11), (32, 3), (2, 1 << 11), (2, 3), (0, 3)])
def test_graph_shuffles_no_pairs_of_light_nodes(spark, monkeypatch, light, block):
    """Light nodes take their other items along, only pairs of a heavy one are summed; what was counted leaves no files."""
    for name, value in (("LIGHT", light), ("BLOCK", block), ("TASK_PAIRS", 40)):
        monkeypatch.setattr(insights, name, value)
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rng = random.Random(5)
    own = {(f"n{n}", i) for n in range(60) for i in rng.sample(range(5), rng.randint(1, 2))} | {(f"h{n}", i) for n in range(3) for i in range(5)}
    want = {}
    for a, i in own:
        for b, j in own:
            if a < b and i == j:
                want[a, b] = want.get((a, b), 0) + 1
    data = [*own, *list(own)[:30], (None, 0), ("n3", None)]
    df = spark.createDataFrame(data, "hypothesis_id string, doc_id long")
    left = files()
    edges = insights.graph(df)
    assert files() <= left
    assert ("hashpartitioning(a#" in edges._jdf.queryExecution().toString()) == (light < 5) and 2 in want.values()
    assert sorted(rows(edges, "a", "b", "w")) == sorted((a, b, w) for (a, b), w in want.items())


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def pdf(pages, flate=True, packed=False, cmap=b""):
    """A PDF of content streams; packed puts its plain objects into an object stream."""

    def stream(data):
        packed_ = zlib.compress(data) if flate else data
        return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(packed_), b"/Filter /FlateDecode " if flate else b"", packed_)

    n = len(pages)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (10 + k) for k in range(n)))}
    plain[3] = b"<< /Type /Font /Subtype /Type0 " + (b"/ToUnicode 4 0 R " if cmap else b"") + b">>"
    plain |= {10 + k: b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (50 + k) for k in range(n)}
    streams = {50 + k: stream(p) for k, p in enumerate(pages)} | ({4: stream(cmap)} if cmap else {})
    if packed:
        bodies, at, index = b"", 0, []
        for k, v in plain.items():
            index.append(b"%d %d" % (k, len(bodies)))
            bodies += v + b" "
        head = b" ".join(index) + b" "
        data = zlib.compress(head + bodies)
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(plain), len(head), len(data), data)
        plain = {}
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in (plain | streams).items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("flate,packed", [(True, False), (False, False), (True, True)])
def test_pdf_text(flate, packed):
    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) ) Tj (w\157rld) Tj 0 -14 Td [(sp) -20 (lit) -400 (gap)] TJ T* <416263> Tj ET"
    two = b"BT 1 0 0 1 72 700 Tm (a) Tj 1 0 0 1 90 700 Tm (b) Tj 1 0 0 1 72 600 Tm (c) ' ET BI /W 1 ID (zz) Tj EI BT (caf\xe9) Tj ET"
    assert office.pdf_text(pdf([one, two], flate, packed)) == "Hello (big) world\nsplit gap\nAbc\n\nab\nccafé"


def test_pdf_with_a_map_to_unicode():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <041F> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0430> <0020> <0021> [<0078> <0079>] endbfrange"
    assert office.pdf_text(pdf([b"BT /F1 9 Tf <0001001000110012000200200021> Tj ET"], cmap=cmap)) == "Пабвfixy"


def test_office_files(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    files = {
        "a.docx": docx(run("First") + "<w:r><w:tab/><w:t>tab</w:t><w:br/><w:t>line</w:t></w:r>", "", f"<w:hyperlink>{run('link &amp; more')}</w:hyperlink>"),
        "b.PDF": pdf([b"BT (text) Tj ET"]), "c.pdf": b"not one", "d.docx": b"PK broken", "e.pdf": pdf([b""]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "f.xls": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {p.rpartition("/")[2]: (c, r) for p, c, r in rows(readers.document_files(spark, str(tmp_path)), "path", "content", "reason")}
    assert got["a.docx"] == ("First\ttab\nline\n\nlink & more", None) and got["b.PDF"] == ("text", None)
    assert {k: r for k, (c, r) in got.items() if c is None} == {"c.pdf": "ValueError: no PDF", "d.docx": "BadZipFile: File is not a zip file", "e.pdf": "ValueError: encrypted", "f.xls": "no reader for xls"}
