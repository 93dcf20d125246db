"""Times, grades and other small expressions. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nz, text


def parse_iso(col: Column) -> Column:
    """A timestamp in UTC; null for anything else."""
    return F.try_to_timestamp(nz(F.trim(col)))


def parse_loose(col: Column) -> Column:
    return F.coalesce(parse_iso(col), parse_iso(F.left(col, F.lit(19))))


def parse_rfc822(col: Column) -> Column:
    bare = F.regexp_replace(F.trim(col), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")))


def is_fresh(pub: Column, as_of: Column, hours: int = 24, iso: bool = False) -> Column:
    """Published in the last hours, the last one included; what cannot be read counts as fresh."""
    ts = F.coalesce(parse_rfc822(pub), parse_iso(pub)) if iso else parse_rfc822(pub)
    return F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(ts) <= hours * 3600, F.lit(True))


def is_overdue(next_check: Column, today: Column) -> Column:
    return F.coalesce(nz(F.left(next_check, F.lit(10))) <= today, F.lit(False))


def is_new(created: Column, as_of: Column, latest_run: Column) -> Column:
    """Created on the day of as_of and not before the latest run."""
    ts, ref = parse_iso(created), parse_iso(latest_run)
    return F.coalesce((F.to_date(ts) == F.to_date(as_of)) & F.coalesce(ts >= ref, F.lit(True)), F.lit(False))


def document_quality(content: Column, source_type: Column, source_ref: Column) -> Column:
    """struct(level, reasons)."""
    n, is_url = F.length(text(content)), F.coalesce(source_type == "url", F.lit(False))
    short = F.when(n < 200, "короткий текст")
    link = F.when((n >= 60) & is_url & ~text(source_ref).rlike("^https?://"), "ссылка не http")
    empty = F.when((n >= 60) & is_url & (n < 400), "страница почти без контента")
    reasons = F.filter(F.array(short, link, empty), lambda r: r.isNotNull())
    return F.struct(F.when(n < 60, "red").when(F.size(reasons) > 0, "yellow").otherwise("green").alias("level"), reasons.alias("reasons"))


def confidence(raw: Column) -> Column:
    c = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(c), 0.0).otherwise(c)))


def is_validated(conf: Column, least: float = 0.9) -> Column:
    return F.when(conf > least, 1).otherwise(0)


def source_kind(n_news: Column, n_all: Column) -> Column:
    return F.when((n_all == 0) | (n_news == 0), "material").when(n_news == n_all, "news").otherwise("mixed")


TIERS = {"admin": 0, "premium": 1, "basic": 2}


def priority(tier: Column, ms: Column) -> Column:
    """Tier first, then time; an unknown tier is a basic one."""
    rank = F.when(tier == "admin", 0).when(tier == "premium", 1).otherwise(2)
    return rank.cast("long") * F.lit(10**13) + ms.cast("long")


def retry_delay(attempt: Column) -> Column:
    return (F.lit(30) * F.pow(F.lit(3), attempt)).cast("long")


def elapsed(started: Column, submitted: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(end) - F.unix_timestamp(F.coalesce(started, submitted)))


def at_rank(values: Column, p: float) -> Column:
    """The element at round((n - 1) p), half to even, of the sorted array; null for none."""
    place = F.bround((F.size(values) - 1) * F.lit(p), 0).cast("int") + 1
    return F.try_element_at(F.array_sort(values), F.greatest(F.lit(1), place))


def concentric(validated: Column, conf: Column, evidence: Column) -> Column:
    return 100 * validated + 40 * conf + F.least(F.lit(20), 2 * evidence)


def day_label(ts: Column, today: Column) -> Column:
    d = F.date_diff(F.to_date(today), F.to_date(ts))
    return F.when(d == 0, "today").when(d == 1, "yesterday").otherwise(F.date_format(ts, "d MMM"))
