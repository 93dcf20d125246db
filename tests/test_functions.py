"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from sparkwire.functions import scores, text, urls
from sparkwire.functions.python import body_text, first_object


def one(spark, expr, *values):
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://A.b:80/C;p=1?x=1&utm_source=z&e=#f", "http://a.b/C?x=1"),
        ("https://a.b/c?q=%20z", "https://a.b/c?q=+z"),
        ("https://a.b/c/", "https://a.b/c/"),
        ("https://a.b/c?UTM_x=1", "https://a.b/c?UTM_x=1"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize, url) == want
    assert one(spark, urls.normalize, want) == want


@pytest.mark.parametrize(
    "url, bad",
    [
        ("", True),
        ("https://example.com", True),
        ("https://t.me/channel/12", True),
        ("https://sber.ru/travel/", True),
        ("https://www.tbank.ru/finance/blog/premium-for-travel/", True),
        ("https://www.vtb.ru/about/press/", False),
        ("https://example.com/news/2026/cards-update/", False),
        ("https://example.com/2026/05/06/story", False),
        ("https://example.com/travel/", True),
        ("https://example.com/cards/", True),
        ("https://example.com/alfa-travel-premium/", True),
        ("https://example.com/some-story", False),
    ],
)
def test_shape(spark, url, bad):
    assert one(spark, urls.is_bad_shape, url) is bad


def test_trust(spark):
    registry = spark.createDataFrame([("tinkoff.ru", 1.0), ("j.tinkoff.ru", 0.7), ("finance.yahoo.com", 0.5)], "domain string, score double")
    df = spark.createDataFrame([(u,) for u in ("https://m.www.x.ru/a", "https://www.m.tinkoff.ru/a", "https://j.tinkoff.ru/a", "https://news.finance.yahoo.com/a", "")], "url string")
    got = {r["url"]: (r["trust_score"], r["trust_matched_domain"]) for r in urls.with_trust(df, "url", registry).collect()}
    assert list(got.values()) and got == {
        "https://m.www.x.ru/a": (0.1, ""),
        "https://www.m.tinkoff.ru/a": (1.0, "tinkoff.ru"),
        "https://j.tinkoff.ru/a": (0.7, "j.tinkoff.ru"),
        "https://news.finance.yahoo.com/a": (0.5, "finance.yahoo.com"),
        "": (0.1, ""),
    }


def test_domain_prefixes_go_once_in_order(spark):
    assert one(spark, urls.domain, "https://m.www.x.ru/a") == "www.x.ru"
    assert one(spark, urls.domain, "https://www.m.tinkoff.ru/a") == "tinkoff.ru"


@pytest.mark.parametrize(
    "pub, fresh",
    [("Wed, 06 May 2026 00:00:00 GMT", True), ("Tue, 05 May 2026 23:59:59 GMT", False), ("Wed, 06 May 2026 02:59:59 +0300", False), ("", True), ("2020-01-01T00:00:00Z", True)],
)
def test_fresh(spark, pub, fresh):
    assert one(spark, lambda c: scores.is_fresh(c, F.to_timestamp(F.lit("2026-05-07T00:00:00Z"))), pub) is fresh


@pytest.mark.parametrize(
    "title, snippet, query, on", [("", "", "x", True), ("hotel deal", "", "", True), ("Bank profit", "", "", False), ("Bank profit", "", "travel banking", True), ("Weather", "", "travel banking", False), ("Скидки на отели", "", "", True)]
)
def test_topic_gate(spark, title, snippet, query, on):
    assert one(spark, text.on_topic, title, snippet, query) is on


@pytest.mark.parametrize(
    "body, topic",
    [
        ("travel AI and Visa", "AI travel в банкинге"),
        ("travel with AI", "AI travel"),
        ("travel and Visa", "Travel в банкинге"),
        ("travel", "NONE"),
        ("AI", "NONE"),
        ("Visa", "NONE"),
        ("AI Visa", "NONE"),
        ("", "NONE"),
        ("ТУРИЗМ и ИИ", "AI travel"),
        ("x" * 1500 + " travel AI", "NONE"),
    ],
)
def test_classify(spark, body, topic):
    assert one(spark, text.classify, "", body) == topic


def test_title_tokens(spark):
    assert set(one(spark, text.title_tokens, "Сбер запустил ИИ агента для путешествий")) == {"сбер", "запустил", "ии", "агента", "путешествий"}


@pytest.mark.parametrize("n, rating", [(199, 1), (200, 2), (800, 3)])
def test_rating_by_length(spark, n, rating):
    assert one(spark, lambda a, b, c: text.rate(a, b, c)["rating"], "t", "x" * n, "NONE") == rating


def test_rating_signals_topic_and_title(spark):
    assert one(spark, lambda a, b, c: text.rate(a, b, c)["rating"], "t", "launch " * 200, "Travel в банкинге") == 5
    assert one(spark, lambda a, b, c: text.rate(a, b, c)["summary"], "the title", "  ", "NONE") == "the title"
    assert one(spark, text.first_sentences, "One. Two! Three…") == "One. Two!"


@pytest.mark.parametrize(
    "n, kind, ref, level", [(59, "file", "", "red"), (60, "file", "", "yellow"), (200, "file", "", "green"), (500, "url", "ftp://x", "yellow"), (300, "url", "http://x", "yellow"), (400, "url", "http://x", "green")]
)
def test_document_quality(spark, n, kind, ref, level):
    assert one(spark, lambda a, b, c: scores.document_quality(a, b, c)["level"], "x" * n, kind, ref) == level


@pytest.mark.parametrize("raw, want", [("UX-UI", "UX/UI"), ("ПУ / подписки", "ПУ/подписки"), ("travel tips", "Travel"), ("прочее", ""), ("", "")])
def test_category(spark, raw, want):
    assert one(spark, text.category, raw) == want


@pytest.mark.parametrize("raw, conf, valid", [("0.9", 0.9, 0), ("0.91", 0.91, 1), ("1.7", 1.0, 1), ("x", 0.0, 0)])
def test_confidence(spark, raw, conf, valid):
    assert one(spark, scores.confidence, raw) == conf
    assert one(spark, lambda c: scores.is_validated(scores.confidence(c)), raw) == valid


def test_digest(spark):
    line = "1. 📰 **T** — 🔗 https://t.me/ch/1 — 🕒 10:00"
    got = one(spark, text.digest_items, f"head\n{line}\n2. 📰 **U** — 🔗 https://t.me/ch/2\n3. 📰 **V** — 🔗 ftp://x")
    assert [tuple(x) for x in got] == [("T", "https://t.me/ch/1", "10:00"), ("U", "https://t.me/ch/2", "")]
    assert one(spark, urls.channel, "https://t.me/ch/1") == "@ch"
    assert one(spark, urls.channel, "https://x.y") == "t.me"


def test_tags(spark):
    assert one(spark, text.clean_tags, "#Онбординг ,онбординг," + "x" * 41 + ",") == "онбординг"
    assert one(spark, text.clean_tags, ",".join(f"t{k}" for k in range(9))).count(",") == 6


def test_priority_and_retry(spark):
    df = spark.createDataFrame([("basic", 5, 0), ("admin", 5, 3), ("?", 1, 1)], "tier string, ms long, n int")
    got = df.select(scores.priority(F.col("tier"), F.col("ms")).alias("p"), scores.retry_delay(F.col("n")).alias("r")).collect()
    assert [(r["p"], r["r"]) for r in got] == [(20000000000005, 30), (5, 810), (20000000000001, 90)]


@pytest.mark.parametrize("values, p, want", [([1.0, 2.0, 3.0, 4.0], 0.5, 3.0), ([1.0, 2.0, 3.0, 4.0], 0.95, 4.0), ([10.0, 20.0], 0.5, 10.0), ([], 0.5, None)])
def test_percentile_by_rank(spark, values, p, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(scores.at_rank(F.col("v"), p).alias("x")).first()["x"] == want


def test_routes(spark):
    got = {q: one(spark, urls.route, q)["lang"] for q in ("site:sber.ru travel", "site:skift.com ai", "тревел банк", "travel ai")}
    assert list(got.values()) == ["ru", "en", "ru", "en"]


def test_balanced_json():
    assert first_object('noise {bad} then {"a":"}{"} tail') == '{"a":"}{"}'
    assert first_object("none") is None and first_object(None) is None


def test_reply(spark):
    raw = 'log {"result": {"payloads": [{"text": "Принято.\\nБуду кратко.\\n- раз\\n\\nОтвет [[reply_to_current]]"}], "meta": {"agentMeta": {"sessionId": "s1"}}}}'
    assert one(spark, lambda c: text.reply_of(c)["reply"], raw) == "Ответ"
    assert one(spark, text.session_id, raw) == "s1"
    assert one(spark, text.scrub_reply, "Принято.\n") == "Понял задачу. Что нужно сделать дальше?"


def test_inline_urls(spark):
    assert one(spark, text.inline_urls, "a https://x.y/1. b https://x.y/1 (https://x.y/2) https://x.y/p.PNG") == ["https://x.y/1", "https://x.y/2"]


def test_aggregator(spark):
    import base64

    token = base64.urlsafe_b64encode(b"\x08\x13\x22 https://site.example/story\xd2\x01").decode().rstrip("=")
    assert one(spark, urls.decode_aggregator, f"https://news.google.com/rss/articles/{token}?x=1") == "https://site.example/story"
    assert one(spark, urls.decode_aggregator, "https://x.y/z") == ""


def test_html(spark):
    page = "<html><title> T </title><script>var a='<p>';</script><p>One &amp; two</p>\n\n\n\n<p>three</p></html>"
    assert one(spark, text.html_to_text, page).endswith("One & two \nthree") or "One & two" in one(spark, text.html_to_text, page)
    assert one(spark, text.page_title, page) == "T"
    assert one(spark, text.strip_tags, "<b>a</b>  c") == "a c"
    assert body_text("<nav><p>menu menu menu</p></nav><p>long enough text</p><div class='ad-banner'><p>buy something</p></div>") == "long enough text"
    assert one(spark, text.is_block_page, "Just a moment...") is True
    assert one(spark, text.without_antibot, "Please verify you are human") == ""


def test_cut_bytes(spark):
    assert one(spark, lambda c: text.cut_bytes(c, 5), "ёёё") == "ёё"
    assert one(spark, lambda c: text.cut_bytes(c, 6), "ёёё") == "ёёё"
