"""URL filter in DataFrame operations only: ordered rules, then a blocked Bloom filter of listed URLs.

Listed canonical URLs set K bits within one 64-bit block of a filter of BLOCKS blocks. The filter is
a table of (block, mask), at most BLOCKS rows of 16 bytes whatever the list's length, so it is
broadcast; a URL whose bits are all set is a possible hit and goes to an exact hash join with the
list, which removes false positives. A longer list makes more false positives, never another result.

Defined cases: a null URL, or one without "://", has empty host and path, meets no rule, is not
listed and is allowed; repeated rows are each returned; an empty list allows what no rule blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

#: (host and path as written, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Hosts whose URLs make up the list of the query.
LISTED_HOSTS = r"^spam-farm\.|(^|\.)cheap-pills\."
BLOCKS, BITS = 1 << 18, 4


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without index page, .html and last slash."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html)?/?$", ""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null, as one expression; for a few rules that are known when the query is built."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        h, p = _split(rule)
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(rule)).otherwise(out)
    return out


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with rule, the longest of rules (rule, verdict) that fits, and ruled, its verdict; for any number of rules.

    A rule meets a URL on one of the endings of its host, so that the join is by equality; distinct
    (host, path) are judged, not rows.
    """
    host, path = ascii_lower(F.regexp_extract("rule", "^([^/]*)", 1)), F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    rules = rules.select(host.alias("end"), path.alias("head"), "rule", F.col("verdict").alias("ruled"))
    own = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = own.select("host", "path", F.explode(F.array_distinct(ends)).alias("end")).join(rules, "end").where(F.col("path").startswith(F.col("head")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("r"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("r.rule").alias("rule"), F.col("r.ruled").alias("ruled"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _mask(url: Column) -> Column:
    h = F.hash(url)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63)) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom(listed: DataFrame, column: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, mask), one row for each block that has a bit."""
    return listed.groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_mask(F.col(column))).alias("mask"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed; `listed` has canonical URLs in column canonical.

    rules: pairs of rule and verdict, compiled, or a table of them (rule, verdict), joined.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        urls = with_rules(urls, rules)
    else:
        verdict = reduce(lambda out, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))
        urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict)
    urls = urls.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    urls = urls.withColumn("block", _block(F.col("canonical"), blocks)).withColumn("want", _mask(F.col("canonical")))
    listed = listed.where("canonical <> ''").select("canonical").distinct()
    tested = urls.join(F.broadcast(bloom(listed, "canonical", blocks)), "block", "left")
    possible = F.coalesce(F.col("mask").bitwiseAND(F.col("want")) == F.col("want"), F.lit(False))
    # what cannot be listed gets a key of its own, so that it meets nothing and heaps up nowhere
    tested = tested.withColumn("key", F.when(possible, F.col("canonical")))
    exact = listed.select(F.col("canonical").alias("key"), F.lit(True).alias("hit"))
    sure = tested.where("key is null").select("page_id", "host", "path", "rule", "ruled", F.lit(False).alias("listed"))
    maybe = tested.where("key is not null").join(exact, "key", "left")
    both = sure.union(maybe.select("page_id", "host", "path", "rule", "ruled", F.coalesce("hit", F.lit(False))))
    return both.withColumn("verdict", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))).drop("ruled")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of the listed hosts."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(host.rlike(LISTED_HOSTS)).select(canonical(host, path).alias("canonical"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html)?/?$', '') AS canonical,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM u),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '^spam-farm\.|(^|\.)cheap-pills\.') AND canonical <> '')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
