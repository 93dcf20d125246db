"""Sinks. A table is replaced as a whole, by Spark's committer; readers see the old or the new one.

The new table is written beside the old one, which is then moved aside, and goes when the new one has
its name. Whatever step a writer is lost at, the old or the new table is whole under one of its two names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace(df: DataFrame, path: str, partition: list[str] | None = None) -> int:
    """Overwrites a table that df may have been read from, and counts it."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.parquet(beside)
    written = spark.read.parquet(beside)
    n = written.count()
    _move(spark, beside, path)
    return n


def _paths(spark: SparkSession, *paths: str) -> tuple:
    """The file system of the last path, and the paths as its own."""
    own = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return own[-1].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *own


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.aside"


def current(spark: SparkSession, path: str) -> str | None:
    """Where the table of that name is to be read: a writer that was lost may have left it aside. None if none was ever written."""
    fs, aside, own = _paths(spark, _aside(path), path)
    return path if fs.exists(own) else _aside(path) if fs.exists(aside) else None


def _rename(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be moved to {new}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, old, aside, new = _paths(spark, source, _aside(target), target)
    if fs.exists(new):
        fs.delete(aside, True)
        _rename(fs, new, aside)
    _rename(fs, old, new)
    fs.delete(aside, True)


def drop(spark: SparkSession, path: str) -> bool:
    fs, target = _paths(spark, path)
    return fs.delete(target, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_buckets(batch: DataFrame, path: str, keys: list[str], order: str, buckets: int = 64) -> list[int]:
    """Keeps the last row of each key in a table dealt to buckets by key; the buckets that were written.

    Only buckets of the batch's keys are read, and only those written in which a key is new or has a later
    row: the files of the others stay as they are. A batch that is run again changes nothing. One writer.
    """
    from sparkwire.operators.windows import last_wins
    from sparkwire.session import checkpoint

    spark = batch.sparkSession
    key = F.struct(*keys)
    new = checkpoint(last_wins(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    met = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    where = current(spark, path)
    old = new.limit(0) if where is None else spark.read.schema(new.schema).parquet(where).where(F.col("bucket").isin(met))
    old = checkpoint(old)  # read before its buckets are written over
    known = old.select(*keys, F.col(order).alias("__was"))
    later = checkpoint(new.join(known, keys, "left").where(F.col("__was").isNull() | (F.col(order) > F.col("__was"))).drop("__was"))
    write = sorted(r["bucket"] for r in later.select("bucket").distinct().collect())
    if write:
        rows = old.where(F.col("bucket").isin(write)).join(later.select(*keys), keys, "left_anti").unionByName(later)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return write


def articles(items: DataFrame, least: int = 200, cut: int = 12_000) -> DataFrame:
    """(hash, text) of the texts worth keeping, the last of each hash."""
    from sparkwire.functions.urls import hash_url
    from sparkwire.operators.windows import last_wins

    rows = items.where(F.length(F.trim("article_text")) >= least).select(hash_url(F.col("url")).alias("hash"), F.left("article_text", F.lit(cut)).alias("text"), "seq")
    return last_wins(rows, "hash").drop("seq")
