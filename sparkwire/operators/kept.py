"""An archive kept with indexes, so that a batch reads and writes only what it can touch.

At path: rows/week=... (the archive), words/week=... (word, seq: the prefix words of titles),
hashes/bucket=... (article_hash, seq, week) and last (the last seq given out). A row of a batch meets rows
of its own hash, and rows of a similar title that are not over five days older. Similar titles share a
prefix word: of the n words of a title, in the order of falling length, the first n - ceil(0.7 n) + 1. So
a batch reads the words of the weeks from five days before it on (and those without a time), and the rows
that they and the hashes name; it writes the weeks of rows that it has added or changed.

The archive is collapsed when it is made; from then on every batch gives what archive.upsert gives on the
whole, where the order of collected_at as text is that of time (one format and zone). Indexes are written
before rows and seqs are reserved before both, so that a batch that was lost in between is simply run
again: an index entry whose row is not there means nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkwire.functions.scores import parse_iso
from sparkwire.functions.text import nz, title_tokens
from sparkwire.session import checkpoint
from sparkwire.sources import sinks

from .archive import upsert
from .dedupe import THRESHOLD, WINDOW_DAYS, collapse

BUCKETS, NO_TIME = 64, -1_000_000


def week(collected: Column) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(parse_iso(collected)) / (7 * 86_400)).cast("int"), F.lit(NO_TIME))


def prefix_words(title: Column, threshold=THRESHOLD) -> Column:
    """The words of which a title shares one with every similar title, whatever else is in the archive."""
    p, q = threshold
    ordered = F.sort_array(F.transform(title_tokens(title), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.array(ordered), lambda all_: F.transform(F.slice(all_, F.lit(1), F.size(all_) - F.ceil(F.size(all_) * p / F.lit(q)).cast("int") + F.when(F.size(all_) > 0, 1).otherwise(0)), lambda x: x["w"]))[0]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("article_hash"), F.lit(BUCKETS)).cast("int")


def _index(rows: DataFrame, path: str, title: str) -> None:
    """Adds rows (with week) to both indexes."""
    words = rows.select("week", "seq", F.explode(prefix_words(F.col(title))).alias("word"))
    words.repartition("week").sortWithinPartitions("week", "word").write.mode("append").partitionBy("week").parquet(f"{path}/words")
    hashes = rows.where(nz(F.col("article_hash")).isNotNull()).select(_bucket().alias("bucket"), "article_hash", "seq", "week")
    hashes.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/hashes")


def _last(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(sinks.current(spark, f"{path}/last")).first()["seq"]


def _reserve(spark: SparkSession, path: str, seq: int) -> None:
    sinks.replace(spark.createDataFrame([(seq,)], "seq long"), f"{path}/last")


def create(archive: DataFrame, path: str, title: str = "title") -> None:
    """Keeps an archive at path; it may be empty."""
    spark = archive.sparkSession
    rows = checkpoint(collapse(archive, title).withColumn("week", week(F.col("collected_at"))))
    _reserve(spark, path, rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0])
    _index(rows, path, title)
    rows.repartition("week").write.partitionBy("week").parquet(f"{path}/rows")
    sinks.replace(rows.drop("week").limit(0), f"{path}/schema")


def _table(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    """A table with its schema given: one without rows has no files to learn it from."""
    return spark.read.schema(columns).parquet(f"{path}/{name}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(sinks.current(spark, f"{path}/schema")).schema
    return spark.read.schema(schema.add("week", IntegerType())).parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop("week")


def touched(spark: SparkSession, path: str, incoming: DataFrame, title: str = "title", days: int = WINDOW_DAYS) -> DataFrame:
    """(seq, week) of the kept rows that a batch (article_hash, title, collected_at) can meet."""
    batch = incoming.select("article_hash", _bucket().alias("bucket"), parse_iso(F.col("collected_at")).alias("ts"), prefix_words(F.col(title)).alias("words"))
    facts = batch.agg(F.collect_set("bucket").alias("buckets"), F.unix_seconds(F.min("ts")).alias("first"), F.count("*").alias("n"), F.count("ts").alias("timed")).first()  # at most BUCKETS numbers
    hashes = _table(spark, path, "hashes", "article_hash string, seq long, week int, bucket int")
    known = hashes.where(F.col("bucket").isin(facts["buckets"])).join(batch.select("article_hash").distinct(), "article_hash", "left_semi").select("seq", "week")
    words = _table(spark, path, "words", "word string, seq long, week int")
    if facts["n"] and facts["n"] == facts["timed"]:
        words = words.where((F.col("week") >= (facts["first"] - days * 86_400) // (7 * 86_400)) | (F.col("week") == NO_TIME))
    near = words.join(batch.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").select("seq", "week")
    return known.union(near).distinct()


def apply(spark: SparkSession, path: str, incoming: DataFrame, as_of: str, title: str = "title", **options) -> dict:
    """Upserts a batch; how many rows it added, how many it changed, and the weeks it wrote."""
    incoming = checkpoint(incoming.withColumn("collected_at", F.coalesce(nz(F.col("collected_at")), F.lit(as_of))))
    rows = _rows(spark, path)
    names = [c for c in rows.columns if c != "week"]
    met = checkpoint(touched(spark, path, incoming, title))
    of = lambda weeks: rows.where(F.col("week").isin(weeks)) if weeks else rows.limit(0)
    weeks = [r["week"] for r in met.select("week").distinct().collect()]  # bounded: as many as the archive has weeks
    old = checkpoint(of(weeks).join(met.select("seq"), "seq", "left_semi").select(names))
    last = _last(spark, path)
    out = upsert(old, incoming, as_of, title, last=last, collapsed=True, **options)
    out = checkpoint(out.select([F.col(c).cast(old.schema[c].dataType).alias(c) if c in out.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in names]))
    placed = week(F.col("collected_at")).alias("week")
    added = out.where(F.col("seq") > last).select("*", placed)
    both = old.alias("o").join(out.alias("n"), F.col("o.seq") == F.col("n.seq"), "left")
    gone = checkpoint(both.where(~_same(names)).select(F.col("o.seq").alias("seq"), week(F.col("o.collected_at")).alias("week")))
    changed = out.join(gone.select("seq"), "seq", "left_semi").select(*names, placed)
    facts = added.agg(F.max("seq"), F.count("*")).first()
    if facts[1]:
        _reserve(spark, path, facts[0])
        _index(added, path, title)
    write = sorted({r["week"] for df in (added, gone) for r in df.select("week").distinct().collect()})
    if write:
        new = of(write).join(gone.select("seq"), "seq", "left_anti").select(*names, "week").join(added.select("seq"), "seq", "left_anti").unionByName(changed).unionByName(added)
        new = checkpoint(new.select(*names, "week"))  # read before its weeks are written over
        new.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(f"{path}/rows")
    return {"added": facts[1], "changed": gone.count(), "weeks": write}


def _same(names: list[str]) -> Column:
    """Whether the old row o and the new one n agree in every column, nulls too."""
    out = F.col("n.seq").isNotNull()
    for c in names:
        out = out & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return out
