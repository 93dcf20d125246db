"""The archive as a stream: each micro-batch is one upsert; and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwire.operators import kept
from sparkwire.operators.archive import upsert
from sparkwire.sources import sinks
from sparkwire.sources.readers import archive as read_archive


def archive_stream(stream: DataFrame, path: str, checkpoint: str, as_of: Callable[[int], str], trigger: dict | None = None, **options) -> StreamingQuery:
    """Upserts every micro-batch into the archive at path. A batch that is run again after a failure
    meets its own rows as known hashes, so that it changes nothing more."""

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        sinks.replace(upsert(read_archive(spark, path), batch, as_of(number), **options), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_stream(stream: DataFrame, path: str, checkpoint: str, as_of: Callable[[int], str], trigger: dict | None = None, **options) -> StreamingQuery:
    """archive_stream over an archive kept with indexes (operators.kept): a batch reads and writes only what it can touch."""

    def each(batch: DataFrame, number: int) -> None:
        kept.apply(batch.sparkSession, path, batch, as_of(number), **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(stream: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """The first of the rows of each key that arrive within `late` of each other, whatever batches they come in."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def latest_by_bucket(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """latest_stream for large tables: a batch reads and writes only the buckets of its keys."""

    def each(batch: DataFrame, number: int) -> None:
        sinks.upsert_buckets(batch, path, keys, order, buckets)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_late(items: DataFrame, late_rows: DataFrame, key: str, at: str, late_at: str, within: str = "2 hours", late: str = "30 minutes") -> DataFrame:
    """Items with the rows of the same key that come up to `within` later: summaries, fields filled in afterwards.

    Both sides need names of their own but for the key. On streams an item without such a row comes out
    once the watermarks of both sides have passed the end of its time; of the rows of one key and time
    the first that arrives counts. On tables the same join.
    """
    other = f"__{key}"
    pairs = late_rows.withColumnRenamed(key, other)
    if items.isStreaming:
        items, pairs = items.withWatermark(at, late), pairs.withWatermark(late_at, late)
    pairs = pairs.dropDuplicates([other, late_at])
    span = (F.col(late_at) >= F.col(at)) & (F.col(late_at) <= F.col(at) + F.expr(f"interval {within}"))
    return items.join(pairs, (F.col(key) == F.col(other)) & span, "leftOuter").drop(other)


def latest_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the last row of each key: reactions, preferences, snapshots."""
    from sparkwire.operators.windows import last_wins

    def each(batch: DataFrame, number: int) -> None:
        where = sinks.current(batch.sparkSession, path)
        old = batch.limit(0) if where is None else batch.sparkSession.read.schema(batch.schema).parquet(where)
        sinks.replace(last_wins(old.unionByName(batch), F.struct(*keys), order), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by window; works on streams, where rows later than `late` are dropped, and on tables."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return own.groupBy(window, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    own = events.withWatermark(ts, late) if events.isStreaming else events
    return own.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), *by, "n")
