"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def nz(col: Column) -> Column:
    """Empty counts as null."""
    return F.when(col != "", col)


def text(col: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(col, F.lit(""))


def trim(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def has(col: Column, pattern: str) -> Column:
    """Case-blind search by the rules of Unicode; null is false."""
    return F.coalesce(col.rlike(P.FLAGS + pattern), F.lit(False))


def contains_any(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (col.contains(w) for w in words), F.lit(False))


def classify(title: Column, body: Column, travel: str = P.TRAVEL, ai: str = P.AI, banking: str = P.BANKING, head: int = 1500) -> Column:
    """The topic of a title and the first characters of its text; NONE unless travel meets AI or banking."""
    blob = F.concat(text(title), F.lit(" "), F.left(text(body), F.lit(head)))
    is_ai, is_bank = has(blob, ai), has(blob, banking)
    return (
        F.when(~has(blob, travel), P.NONE)
        .when(is_ai & is_bank, P.AI_BANK_TRAVEL)
        .when(is_ai, P.AI_TRAVEL)
        .when(is_bank, P.BANK_TRAVEL)
        .otherwise(P.NONE)
    )


def on_topic(title: Column, snippet: Column, query: Column, travel: str = P.GATE_TRAVEL, banking: str = P.GATE_BANKING, ai: str = P.GATE_AI) -> Column:
    """The gate before collection: nothing to judge by passes; a query's topic counts if the hit has banking or AI."""
    blob = trim(F.concat(text(title), F.lit(" "), text(snippet)))
    return (blob == "") | has(blob, travel) | (has(query, travel) & (has(blob, banking) | has(blob, ai)))


def is_block_page(col: Column, head: int = 800) -> Column:
    return contains_any(F.lower(F.left(text(col), F.lit(head))), P.BLOCK_MARKERS)


def without_antibot(col: Column, head: int = 2000) -> Column:
    """Empty where the beginning is that of a check for robots."""
    return F.when(has(F.left(col, F.lit(head)), P.ANTIBOT), "").otherwise(col)


def strip_tags(col: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(text(col), "<[^>]+>", " "), r"(?U)\s+", " "))


#: Named entities that are replaced, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape(col: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), col)


def html_to_text(col: Column) -> Column:
    out = F.regexp_replace(text(col), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = unescape(F.regexp_replace(out, "<[^>]+>", " "))
    out = F.regexp_replace(out, "[ \t\r\f\u000b]+", " ")
    return trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s*\n\s*", "\n"), r"\n{3,}", "\n\n"))


def page_title(html: Column) -> Column:
    return trim(F.regexp_extract(text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def title_tokens(col: Column, stop=P.TITLE_STOP) -> Column:
    """The set of lower-cased words of two letters at least that are no stop words."""
    words = F.transform(F.regexp_extract_all(text(col), F.lit(P.TITLE_WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; zero if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_sentences(col: Column, n: int = 2, most: int = 600) -> Column:
    body = trim(text(col))
    # the body has no blank ends, so that no part is empty, and what follows the first n need not be split
    parts = F.filter(F.transform(F.split(body, r"(?U)(?<=[.!?…])\s+", n + 1), trim), lambda s: s != "")
    return F.left(F.array_join(F.slice(parts, 1, n), " "), F.lit(most))


def rate(title: Column, body: Column, topic: Column, signals: str = P.SIGNALS, in_banking: str = P.IN_BANKING) -> Column:
    """struct(summary, rating 1 to 5, signals): the offline model."""
    def judged(of: Column, title: Column, topic: Column) -> Column:
        def scored(n: Column) -> Column:
            one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
            score = F.lit(1) + one(F.length(of) >= 200) + one(F.length(of) >= 800) + one(n >= 2) + one(topic.contains(in_banking))
            summary = F.coalesce(nz(first_sentences(of)), nz(title), F.lit("(нет текста)"))
            return F.struct(summary.alias("summary"), F.least(F.lit(5), score).alias("rating"), n.alias("signals"), F.length(of).alias("length"))

        return bound(F.size(F.regexp_extract_all(of, F.lit(P.FLAGS + signals), F.lit(0))), scored)

    title, body = text(title), text(body)
    of = F.when(F.length(trim(body)) >= F.length(trim(title)), body).otherwise(title)
    return bound(F.struct(of.alias("of"), title.alias("title"), topic.alias("topic")), lambda x: judged(x["of"], x["title"], x["topic"]))


def category(raw: Column) -> Column:
    """The category that a free label means; empty if none."""
    r = F.replace(F.replace(F.lower(trim(text(raw))), F.lit("-"), F.lit("/")), F.lit(" / "), F.lit("/"))
    out = F.when(text(raw) == "", "")
    for name in ("UX/UI", "Travel", "ПУ/подписки"):
        out = out.when(r.isin(*P.CATEGORY_WORDS[name]), name)
    for name in P.CATEGORIES:
        out = out.when(r.contains(name.lower()), name)
    return out.otherwise("")


def scrub_reply(col: Column) -> Column:
    """A model's reply without echoed rules and transport tags."""
    out = F.regexp_replace(F.regexp_replace(col, P.REPLY_PREAMBLE, ""), P.REPLY_RULE_LINE, "")
    out = trim(F.regexp_replace(F.replace(out, F.lit("[[reply_to_current]]"), F.lit("")), r"\n{3,}", "\n\n"))
    return F.when((out == "") & (trim(col) != ""), P.REPLY_STUB).otherwise(out)


def in_language(message: Column, hint: str = P.LANGUAGE_HINT) -> Column:
    """A message to the model, with the rule that names the answer's language; null is empty."""
    return F.concat(text(message), F.lit(hint))


def envelope(raw: Column) -> Column:
    """struct(reply, error, session) of an agent's JSON, of whatever shape: its payload texts, else its summary; its session's id.

    The JSON is parsed once, to a variant, whose paths are read where they are there and of a fitting kind:
    what else an object holds, or holds in their place, does not matter.
    """
    start = F.instr(raw, "{")

    def read(v: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(v, "$.result.payloads", "array<variant>"), F.try_variant_get(v, "$.payloads", "array<variant>"))
        texts = F.filter(F.transform(listed, lambda p: trim(text(F.try_variant_get(p, "$.text", "string")))), lambda t: t != "")
        reply = F.coalesce(nz(F.array_join(texts, "\n\n")), nz(F.try_variant_get(v, "$.summary", "string")))
        paths = ("$.result.meta.agentMeta.sessionId", "$.meta.agentMeta.sessionId", "$.sessionId")
        session = F.coalesce(*[nz(F.try_variant_get(v, p, "string")) for p in paths], F.lit(""))
        return F.struct(text(scrub_reply(reply)).alias("reply"), F.when(reply.isNull(), "no reply").alias("error"), session.alias("session"))

    return bound(F.when(start > 0, F.try_parse_json(F.substr(raw, F.greatest(F.lit(1), start)))), read)


def bound(col: Column, use) -> Column:
    """use(col), col being evaluated once however often it is used: a lambda's variable is not inlined."""
    return F.transform(F.array(col), use)[0]


def reply_of(raw: Column) -> Column:
    """struct(reply, error) of an agent's JSON: its payload texts, else its summary."""
    return bound(envelope(raw), lambda e: F.struct(e["reply"].alias("reply"), e["error"].alias("error")))


def session_id(raw: Column) -> Column:
    return envelope(raw)["session"]


def inline_urls(col: Column, most: int = 4) -> Column:
    """The first distinct URLs in a text that are no images or other assets."""
    found = F.transform(F.regexp_extract_all(text(col), F.lit(r"""(?U)https?://[^\s<>"')\]]+"""), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)>]+$", ""))
    asset = lambda u: reduce(lambda a, b: a | b, (F.lower(u).endswith(e) for e in P.ASSETS))
    return F.slice(F.array_distinct(F.filter(found, lambda u: ~asset(u))), 1, most)


def clean_tags(csv: Column, most: int = 7) -> Column:
    """Tags as they are kept: lower case, without #, 1 to 40 characters, distinct, in order."""
    tags = F.transform(F.split(text(csv), ","), lambda t: F.regexp_replace(F.lower(trim(t)), r"^#+|#+$", ""))
    return F.array_join(F.slice(F.array_distinct(F.filter(tags, lambda t: F.length(t).between(1, 40))), 1, most), ",")


def upload_tags(csv: Column, most: int = 500) -> Column:
    tags = F.filter(F.transform(F.split(text(csv), ","), trim), lambda t: t != "")
    return F.left(F.array_join(tags, ","), F.lit(most))


def shorten(col: Column, n: int, ellipsis: bool = True) -> Column:
    cut = F.left(col, F.lit(n))
    return F.when(F.length(col) > n, F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit("…")) if ellipsis else cut).otherwise(col)


def cut_bytes(col: Column, most: int) -> Column:
    """The longest head of at most so many UTF-8 bytes that ends on a whole character."""
    head = F.substring(F.encode(col, "UTF-8"), 1, most)
    return F.when(F.octet_length(col) <= most, col).otherwise(F.regexp_replace(F.call_function("make_valid_utf8", head.cast("string")), "�+$", ""))


def search_terms(query: Column, most: int = 12) -> Column:
    """The words of a full-text query, each to be matched as a prefix."""
    return F.slice(F.regexp_extract_all(text(query), F.lit(r"(?U)[\w\-]+"), F.lit(0)), 1, most)


def anchors(html: Column) -> Column:
    """array of struct(href, label): anchors with labels of 15 to 200 characters."""
    pattern = r"""(?is)<a[^>]+href=["']([^"'#]+)["'][^>]*>([^<]{15,200})</a>"""
    hrefs, labels = (F.regexp_extract_all(text(html), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(hrefs, labels, lambda h, t: F.struct(h.alias("href"), trim(t).alias("label")))


def digest_items(summary: Column) -> Column:
    """array of struct(title, url, posted_at) of a digest's numbered lines."""
    parts = [F.regexp_extract_all(text(summary), F.lit(P.DIGEST_ITEM), F.lit(g)) for g in (1, 2, 3)]
    bare = lambda c: F.regexp_replace(trim(text(c)), "[.,;:]+$", "")
    items = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("a", "b", "c"), strict=True)]), lambda x: F.struct(trim(x["a"]).alias("title"), bare(x["b"]).alias("url"), bare(x["c"]).alias("posted_at")))
    return F.filter(items, lambda x: (x["title"] != "") & x["url"].startswith("http"))
