"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import has, nz, text


def host(url: Column) -> Column:
    """Lower case, without user, port or brackets; empty if there is none."""
    netloc = F.regexp_extract(text(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(bare, r"^\[|\]$", ""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(text(url), r"(?s)^[^?#]*\?([^#]*)", 1)


def normalize(url: Column) -> Column:
    """Without port, user, fragment, parameters of the last segment, utm_* and blank query parameters."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: ~p.startswith("utm_") & p.rlike("(?s)^[^=]*=.+"))
    again = lambda s: F.url_encode(F.coalesce(F.try_url_decode(s), s))
    clean = F.transform(pairs, lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.lit("="), again(F.regexp_extract(p, "(?s)=(.*)", 1))))
    bare = F.regexp_replace(path(url), r";[^/]*$", "")
    tail = F.when(F.size(clean) > 0, F.concat(F.lit("?"), F.array_join(clean, "&"))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), bare, tail)


def domain(url: Column) -> Column:
    """The host without the prefixes www, m, mobile, amp, ru, en, each once and in this order."""
    return F.regexp_replace(host(url), r"^(?:www\.)?(?:m\.)?(?:mobile\.)?(?:amp\.)?(?:ru\.)?(?:en\.)?", "")


def suffixes(name: Column) -> Column:
    """a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


#: A registry with more rows is joined by shuffle, not broadcast.
SMALL_REGISTRY = 100_000


def with_trust(df: DataFrame, url: str, registry: DataFrame, default: float = 0.10) -> DataFrame:
    """Adds trust_score and trust_matched_domain: of the longest suffix of the URL's domain that registry (domain, score) has.

    Distinct domains are scored, not rows: a host that holds a third of all rows is one row of the
    join. The registry is broadcast only if it is counted to be small.
    """
    registry = registry.groupBy("domain").agg(F.max("score").alias("score"))
    small = registry.limit(SMALL_REGISTRY + 1).count() <= SMALL_REGISTRY
    df = df.withColumn("__domain", domain(F.col(url)))
    names = df.select("__domain").distinct().select("__domain", F.posexplode(suffixes(F.col("__domain"))).alias("__pos", "domain"))
    hits = names.join(F.broadcast(registry) if small else registry, "domain")
    best = hits.groupBy("__domain").agg(F.min_by(F.struct("score", "domain"), "__pos").alias("__hit"))
    out = df.join(best, "__domain", "left")
    return out.withColumn("trust_score", F.coalesce("__hit.score", F.lit(default))).withColumn("trust_matched_domain", F.coalesce("__hit.domain", F.lit(""))).drop("__domain", "__hit")


def ensure_trust(df: DataFrame, url: str, registry: DataFrame, default: float = 0.10) -> DataFrame:
    """Fills a null trust_score, and its domain, by with_trust."""
    filled = with_trust(df.withColumnsRenamed({"trust_score": "__score", "trust_matched_domain": "__matched"}), url, registry, default)
    matched = F.when(F.col("__score").isNull(), F.col("trust_matched_domain")).otherwise(text(F.col("__matched")))
    return filled.withColumn("trust_matched_domain", matched).withColumn("trust_score", F.coalesce("__score", "trust_score")).drop("__score", "__matched")


def _with_www(hosts) -> list[str]:
    return [x for h in hosts for x in (h, f"www.{h}")]


#: The decision list's patterns by name; replace some for another domain of URLs.
SHAPES = {
    "bad_host": P.BAD_HOST, "news_path": P.NEWS_PATH, "bank_news_path": P.BANK_NEWS_PATH, "whitelist": P.NEWS_PATH_WHITELIST,
    "landing": P.LANDING_PATH, "bad_path": P.BAD_PATH, "product": P.PRODUCT_PATH,
    "news_hosts": _with_www(P.TRADE_HOSTS + P.BANK_HOSTS) + P.PRESS_HOSTS, "bank_hosts": _with_www(P.BANK_HOSTS),
}


def shape(url: Column, **shapes) -> Column:
    """The rule that decides on a URL, in order; those of GOOD are articles."""
    s, h, p = SHAPES | shapes, host(url), path(url)
    return (
        F.when(text(url) == "", "empty")
        .when(has(h, s["bad_host"]), "bad_host")
        .when(p.isin("", "/"), "root")
        .when(h.isin(*s["news_hosts"]) & ~has(p, s["news_path"]), "no_news_path")
        .when(h.isin(*s["bank_hosts"]) & ~has(p, s["bank_news_path"]), "no_bank_news_path")
        .when(has(p, s["whitelist"]), "whitelist")
        .when(has(p, s["landing"]), "landing")
        .when(has(p, s["bad_path"]), "bad_path")
        .when(has(p, s["product"]), "product")
        .otherwise("plain")
    )


GOOD = ("whitelist", "plain")


def is_bad_shape(url: Column, **shapes) -> Column:
    return ~shape(url, **shapes).isin(*GOOD)


def channel(url: Column) -> Column:
    """@name of a channel's link, else t.me."""
    name = F.regexp_extract(text(url), r"(?s)^.*?t\.me/([^/]*)", 1)
    return F.when(name != "", F.concat(F.lit("@"), name)).otherwise("t.me")


def decode_aggregator(url: Column) -> Column:
    """The publisher's URL inside an aggregator's encoded article path; empty if none."""
    token = F.regexp_extract(text(url), "/articles/([A-Za-z0-9_-]+)", 1)
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract_all(decoded, F.lit("""https?://[^\\s\\x00-\\x1f"'<>\\x80-\\xff]+"""), F.lit(0))
    good = F.filter(found, lambda u: ~u.contains("news.google.com") & ~u.contains("google.com/rss") & (F.length(u) >= 16))
    return F.when(F.length(token) % 4 != 1, F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))).otherwise("")


def resolved(url: Column, final: Column, is_aggregator: Column) -> Column:
    """Where a link leads: its own encoding, else what was looked up; an aggregator's own page counts as nothing."""
    return F.when(is_aggregator, F.coalesce(nz(decode_aggregator(url)), nz(final), F.lit(""))).otherwise(F.coalesce(nz(final), url))


def has_cyrillic(col: Column) -> Column:
    return text(col).rlike(r"[\x{0400}-\x{04FF}]")


def search_feed(q: Column) -> Column:
    """The query's feed locale: ru if it has Cyrillic letters, else en."""
    return F.when(text(q).rlike("[а-яА-ЯёЁ]"), "ru").otherwise("en")


#: Engines by kind of query.
ENGINES = {"site_ru": "yandex,bing,duckduckgo", "site_en": "bing,duckduckgo,brave", "ru": "yandex,duckduckgo,bing", "en": "duckduckgo,bing,brave"}


def route(q: Column, engines: dict = ENGINES) -> Column:
    """struct(engines, lang) of a search query."""
    low = F.lower(text(q))
    tail = F.left(F.regexp_extract(low, "(?s)^.*?site:(.*)", 1), F.lit(30))
    site = low.contains("site:")
    kind = F.when(site & (tail.contains(".ru") | tail.contains(".by")), "site_ru").when(site, "site_en").when(has_cyrillic(q), "ru").otherwise("en")
    table = F.create_map(*[F.lit(x) for kv in engines.items() for x in kv])
    return F.struct(table[kind].alias("engines"), F.when(kind.endswith("ru"), "ru").otherwise("en").alias("lang"))


def hash_url(url: Column) -> Column:
    return F.left(F.sha2(text(url), 256), F.lit(16))


def hash_url_title(url: Column, title: Column) -> Column:
    return F.left(F.sha2(F.concat(text(url), F.lit("\n"), text(title)), 256), F.lit(16))


def news_id(url: Column, article_hash: Column | None = None) -> Column:
    own = hash_url(url) if article_hash is None else F.coalesce(nz(F.left(article_hash, F.lit(16))), hash_url(url))
    return F.concat(F.lit("news:"), own)
