"""Orders, caps and runs. Ties are always broken by the last column, the input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.functions.text import nz
from sparkwire.session import checkpoint


def first_wins(df: DataFrame, key: Column | str, order: str = "seq") -> DataFrame:
    """The first row of each key. A partial aggregate picks it, so that a hot key is no hot task."""
    key = F.col(key) if isinstance(key, str) else key
    return _pick(df, key, F.min_by, order)


def last_wins(df: DataFrame, key: Column | str, order: str = "seq") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return _pick(df, key, F.max_by, order)


def _pick(df: DataFrame, key: Column, by, order: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key.alias("__key")).agg(by(row, F.col(order)).alias("__row")).select("__row.*")


def top_per_key(df: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows of a key in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def round_robin(df: DataFrame, budget: int, source: str = "source", order: str = "seq") -> DataFrame:
    """Rows in turn of their sources, sources by their first row, at most `budget`.

    No source gives more than `budget` rows, so that each is cut to so many before they meet.
    """
    src = F.coalesce(nz(F.col(source)), F.lit("_"))
    keyed = df.withColumn("__src", src)
    cut = keyed.withColumn("__turn", F.row_number().over(Window.partitionBy("__src").orderBy(order))).where(F.col("__turn") <= budget)
    first = keyed.groupBy("__src").agg(F.min(order).alias("__first"))
    return cut.join(first, "__src").orderBy("__turn", "__first").limit(budget).drop("__src", "__turn", "__first")


def host_cap(df: DataFrame, host: str, per_host: int, most: int, group: list[str] | None = None, order: str = "seq") -> DataFrame:
    """At most per_host rows of a host, then at most `most` rows, within each group."""
    group = group or []
    capped = top_per_key(df, [*group, host], per_host, F.col(order))
    return top_per_key(capped, group, most, F.col(order)) if group else capped.orderBy(order).limit(most)


def _grouped(group: list[str] | None) -> list[str]:
    if not group:
        raise ValueError("a window over all rows is one task; use until_breaker() without a group, or numbered()")
    return group


def empty_runs(df: DataFrame, is_empty: Column, order: str = "seq", group: list[str] | None = None) -> DataFrame:
    """Adds empties_before: the number of empty rows right before a row, since the last that was not, within each group."""
    w = Window.partitionBy(*_grouped(group)).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.withColumn("__empty", F.when(is_empty, 1).otherwise(0))
    marked = flagged.withColumn("__n", F.row_number().over(w))
    last = F.coalesce(F.max(F.when(F.col("__empty") == 0, F.col("__n"))).over(before), F.lit(0))
    return marked.withColumn("empties_before", F.col("__n") - 1 - last).drop("__empty", "__n")


def until_breaker(df: DataFrame, is_empty: Column, limit: int = 25, order: str = "seq", group: list[str] | None = None) -> DataFrame:
    """The rows before the first one that follows `limit` empty rows in a row."""
    if not group:
        return _until_first(df, is_empty, limit, order)
    runs = empty_runs(df, is_empty, order, group)
    w = Window.partitionBy(*group).orderBy(order)
    return runs.withColumn("__hit", F.max(F.when(F.col("empties_before") >= limit, 1).otherwise(0)).over(w)).where("__hit = 0").drop("__hit", "empties_before")


def _until_first(df: DataFrame, is_empty: Column, limit: int, order: str) -> DataFrame:
    """until_breaker() over all rows: the row after `limit` empty ones has that many among the places before it."""
    placed = numbered(df, order, "__place")
    ahead = placed.where(is_empty).select(F.explode(F.sequence(F.col("__place") + 1, F.col("__place") + limit)).alias("p"))
    first = ahead.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") == limit).agg(F.min("p")).first()[0] if limit else 1
    return (placed if first is None else placed.where(F.col("__place") < first)).drop("__place")


def queue_position(df: DataFrame, priority: str = "priority", parts: int = 64) -> DataFrame:
    """Adds queue_pos: the number of rows of this priority or a lesser one.

    Priorities are cut into ranges; each range counts its own rows in order, and the sums of the
    ranges before it, `parts` numbers, are added.
    """
    counts = df.groupBy(priority).agg(F.count("*").alias("__n"))
    cuts = counts.agg(F.percentile_approx(priority, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(F.col(priority) > c, 1).otherwise(0)
    counts = counts.withColumn("__part", part)
    before, base = 0, {}
    for r in counts.groupBy("__part").agg(F.sum("__n").alias("n")).orderBy("__part").collect():  # bounded: parts rows
        base[r["__part"]] = before
        before += r["n"]
    table = F.create_map(*[F.lit(x).cast("long") for kv in (base or {0: 0}).items() for x in kv])
    within = F.sum("__n").over(Window.partitionBy("__part").orderBy(priority))
    places = counts.withColumn("queue_pos", within + table[F.col("__part").cast("long")]).select(priority, "queue_pos")
    return df.join(places, priority)


def numbered(df: DataFrame, order: str, name: str, base: int = 0) -> DataFrame:
    """Adds name: base + 1, base + 2, ... in order, without a window over all rows.

    Rows are sorted into ranges, numbered within each, and moved by the sizes of the ranges before.
    """
    ranged = checkpoint(df.orderBy(order).withColumn("__range", F.spark_partition_id()))
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # bounded: partitions
    start, before = {}, base
    for k in sorted(sizes):
        start[k] = before
        before += sizes[k]
    moved = F.create_map(*[F.lit(x) for kv in (start or {0: 0}).items() for x in kv])[F.col("__range")]
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn(name, (moved + within).cast("long")).drop("__range")


def best_snippets(df: DataFrame, key: list[str], text: str = "text", order: str = "seq", least: int = 30, head: int = 60, cut: int = 600, most: int = 8) -> DataFrame:
    """Distinct snippets by their first characters, the longest first."""
    own = df.withColumn(text, F.trim(F.col(text))).where(F.length(text) >= least).withColumn("__head", F.lower(F.left(F.col(text), F.lit(head))))
    first = top_per_key(own, [*key, "__head"], 1, F.col(order)).withColumn(text, F.left(F.col(text), F.lit(cut)))
    return top_per_key(first.drop("__head"), key, most, F.desc(F.length(text)), F.col(order))
