"""The job table: metrics, positions, recovery, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.functions.scores import elapsed, parse_iso, priority, retry_delay
from sparkwire.functions.text import nz

from .windows import queue_position

FINISHED = ("done", "error", "cancelled", "interrupted")


def _measured(jobs: DataFrame, since: str | None) -> DataFrame:
    sub, start, end = (parse_iso(F.col(c).cast("string")) for c in ("submitted_at", "started_at", "finished_at"))
    rows = jobs if since is None else jobs.where(F.col("submitted_at") >= since)
    seconds = lambda a, b: F.unix_micros(b) / 1e6 - F.unix_micros(a) / 1e6
    is_done = (F.col("status") == "done") & start.isNotNull() & end.isNotNull()
    return rows.withColumn("__done", F.coalesce(is_done, F.lit(False))).withColumn("__run", F.when(is_done, seconds(start, end))).withColumn("__wait", F.when(sub.isNotNull() & start.isNotNull(), F.greatest(F.lit(0.0), seconds(sub, start))))


def metrics(jobs: DataFrame, since: str | None = None) -> DataFrame:
    """(dimension, name, counts, error_rate, durations and waits) by kind and by tier.

    A percentile is an element of the group's sorted values, given in whole seconds. So the rows of each
    whole second are counted, in every task first, and the element is found by running counts: what a
    group's window holds are its distinct seconds, never its rows.
    """
    rows = _measured(jobs, since)
    errors = F.count_if(F.col("status").isin("error", "interrupted"))
    cells = rows.select("*", F.explode(F.array(F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("name")), F.struct(F.lit("tier").alias("dimension"), F.col("tier").alias("name")))).alias("g"))
    base = cells.groupBy("g.dimension", "g.name").agg(
        F.count("*").alias("count"), F.count_if("__done").alias("done"), errors.alias("errors"), F.bround(errors / F.count("*"), 3).alias("error_rate"),
        F.coalesce(F.avg("__run"), F.lit(0.0)).cast("long").alias("avg_duration_s"),
    )
    measures = F.explode(F.array(F.struct(F.lit("duration").alias("what"), F.col("__run").alias("v")), F.struct(F.lit("wait").alias("what"), F.col("__wait").alias("v"))))
    seconds = cells.select("g.dimension", "g.name", measures.alias("m")).where("m.v is not null").groupBy("dimension", "name", "m.what", F.col("m.v").cast("long").alias("v")).agg(F.count("*").alias("c"))
    group = Window.partitionBy("dimension", "name", "what")
    ranked = seconds.withColumn("before", F.sum("c").over(group.orderBy("v")) - F.col("c")).withColumn("n", F.sum("c").over(group))
    at = lambda p: F.bround((F.col("n") - 1) * p).cast("long")
    of = lambda what, p: F.coalesce(F.max(F.when((F.col("what") == what) & (F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("c")), F.col("v"))), F.lit(0).cast("long")).alias(f"p{round(100 * p)}_{what}_s")
    points = ranked.groupBy("dimension", "name").agg(*[of(what, p) for what in ("duration", "wait") for p in (0.5, 0.95)])
    zero = [F.coalesce(F.col(f"p{p}_{what}_s"), F.lit(0).cast("long")).alias(f"p{p}_{what}_s") for what in ("duration", "wait") for p in (50, 95)]
    met = base.join(points.withColumnsRenamed({"dimension": "__d", "name": "__n"}), (F.col("dimension") == F.col("__d")) & F.col("name").eqNullSafe(F.col("__n")), "left")
    return met.select("dimension", "name", "count", "done", "errors", "error_rate", zero[0], zero[1], "avg_duration_s", zero[2], zero[3])


def totals(jobs: DataFrame, since: str | None = None) -> DataFrame:
    rows = jobs if since is None else jobs.where(F.col("submitted_at") >= since)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in (*FINISHED, "running", "queued")])


def queue(jobs: DataFrame) -> DataFrame:
    return queue_position(jobs.where("status = 'queued'"))


def status(jobs: DataFrame, ident: str, as_of: str) -> DataFrame:
    end = F.coalesce(parse_iso(F.col("finished_at")), F.to_timestamp(F.lit(as_of)))
    own = jobs.where(F.col("id") == ident).withColumn("elapsed_s", elapsed(parse_iso(F.col("started_at")), parse_iso(F.col("submitted_at")), end))
    return own.join(queue(jobs).select("id", "queue_pos"), "id", "left")


def find_active(jobs: DataFrame, kind: str, user: str | None = None) -> DataFrame:
    rows = jobs.where((F.col("kind") == kind) & F.col("status").isin("queued", "running"))
    return (rows if user is None else rows.where(F.col("user") == user)).orderBy("submitted_at", "id").limit(1)


def admin_list(jobs: DataFrame, recent: int = 50) -> dict[str, DataFrame]:
    return {
        "queued": queue(jobs).orderBy("priority", "id"),
        "running": jobs.where("status = 'running'").orderBy("started_at", "id"),
        "recent": jobs.where(F.col("status").isin(*FINISHED)).orderBy(F.desc(F.coalesce(nz(F.col("finished_at")), F.col("submitted_at"))), "id").limit(recent),
    }


def submitted(requests: DataFrame) -> DataFrame:
    """Requests (id, user, tier, kind, ms, submitted_at) as queued jobs."""
    return requests.withColumn("priority", priority(F.col("tier"), F.col("ms"))).withColumn("status", F.lit("queued")).withColumn("attempts", F.lit(0))


def cancelled(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Queued jobs end at once, running ones are asked to."""
    own = jobs.join(ids.select("id").withColumn("__c", F.lit(True)), "id", "left")
    queued, running = F.col("__c") & (F.col("status") == "queued"), F.col("__c") & (F.col("status") == "running")
    out = own.withColumn("finished_at", F.when(queued, F.lit(as_of)).otherwise(F.col("finished_at"))).withColumn("cancel_req", F.when(running, 1).otherwise(F.col("cancel_req")))
    return out.withColumn("status", F.when(queued, "cancelled").otherwise(F.col("status"))).drop("__c")


def retried(jobs: DataFrame, now_ms: int, most: int = 4) -> DataFrame:
    """Jobs that failed for a passing reason (column transient) go back with a later priority."""
    again = F.col("transient") & (F.col("status") == "error") & (F.col("attempts") < most)
    later = priority(F.col("tier"), F.lit(now_ms) + retry_delay(F.col("attempts")) * 1000)
    out = jobs.withColumn("priority", F.when(again, later).otherwise(F.col("priority"))).withColumn("attempts", F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")))
    return out.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def recovered(jobs: DataFrame, kinds: DataFrame, as_of: str) -> DataFrame:
    """Running jobs after a restart: queued again if their kind (kind, recover, serial) allows, else interrupted."""
    own = jobs.join(kinds, "kind", "left")
    was = F.col("status") == "running"
    again = was & F.coalesce("recover", F.lit(False)) & ~F.coalesce("serial", F.lit(False)) & (F.col("attempts") < 2)
    out = own.withColumn("finished_at", F.when(was & ~again, F.lit(as_of)).otherwise(F.col("finished_at"))).withColumn("started_at", F.when(again, None).otherwise(F.col("started_at")))
    return out.withColumn("status", F.when(again, "queued").when(was, "interrupted").otherwise(F.col("status"))).drop("recover", "serial")


def cleaned(jobs: DataFrame, events: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Jobs without those long finished, and events without those of jobs that are gone."""
    edge = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    old = F.col("status").isin(*FINISHED) & (parse_iso(F.col("finished_at")) < edge)
    kept = jobs.where(~F.coalesce(old, F.lit(False)))
    return kept, events.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi")
