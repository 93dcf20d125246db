"""Streams with kept state, late pairs and duplicates across batches, against the same on tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwire.functions import patterns as P
from sparkwire.operators import state
from sparkwire.sources import sinks
from sparkwire.streaming import incremental, keyed


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def run(spark, tmp_path, name, schema, batches, make, mode="append"):
    """The rows of a stream to which a batch at a time comes, the query being started anew, from its checkpoint, for each."""
    source, out, ck = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "ck"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


EVENTS = "id string, seq long, kind string, value string, caller string, is_admin boolean, confirm boolean"


def test_lifecycle_stream_equals_fold(spark, tmp_path):
    keyed.use_store(spark)
    rng = random.Random(4)
    events = []
    for k in range(90):
        kind = rng.choice(["transition", "transition", "owner", "next_check", "other"])
        value = {"transition": rng.choice(list(P.TRANSITIONS) + ["archived", "nowhere"]), "owner": rng.choice(["a", "b", "", None]), "next_check": rng.choice(["2026-01-02", "soon", "", "2026-13-01", None])}.get(kind)
        events.append((f"h{rng.randint(0, 8)}", k, kind, value, rng.choice(["a", "b"]), rng.choice([True, False, None]), rng.choice([True, None])))
    start = spark.createDataFrame([(f"h{k}", "synthesized" if k % 2 else "in_review", "a" if k % 3 else None, None) for k in range(8)], "id string, lifecycle_status string, owner_username string, next_check_at string")
    names = [f.split()[0] for f in state.FOLDED.split(", ")]
    want = rows(state.fold(start, spark.createDataFrame(events, EVENTS)), *names)
    assert len({r[3] for r in want}) > 5
    cut = [events[:40], events[40:41], events[41:]]
    assert rows(run(spark, tmp_path, "life", EVENTS, cut, lambda s: keyed.lifecycle(s, start)), *names) == want


JOB = "id string, seq long, event string, at_ms long, transient boolean, ts timestamp"


def plain_jobs(events, until, most=4, days=30):
    """Status changes of each job by a loop over its events and what falls due up to `until`."""
    out = []
    for ident in sorted({e[0] for e in events}):
        status, attempts, due = None, 0, None

        def settle(t, ident=ident):
            nonlocal status, attempts, due
            if due is not None and due <= t:
                if status == "waiting":
                    status = "queued"
                    out.append((ident, due, "retry", "queued", attempts))
                else:
                    status, attempts = None, 0
                due = None

        for _, _, event, at, transient, _ in sorted((e for e in events if e[0] == ident), key=lambda e: e[1]):
            settle(at)
            was = status
            status, attempts, again = keyed.job_step(status, attempts, event, transient, most)
            if status != was:
                due = at + keyed.retry_ms(attempts - 1) if again else at + days * keyed.DAY_MS if status in keyed.FINISHED else None
                out.append((ident, at, event, status, attempts))
        settle(until)
    return sorted(out, key=str)


def test_jobs_with_timers(spark, tmp_path):
    keyed.use_store(spark)
    rng = random.Random(12)
    zero = datetime(2026, 1, 1)
    t, events = 0, []
    for k in range(120):
        t += rng.choice([1, 5, 20, 60]) * 1000
        event = rng.choice(["submit", "start", "fail", "fail", "start", "finish", "cancel", "restart"])
        at = zero + timedelta(milliseconds=t)
        events.append((f"j{rng.randint(0, 5)}", k, event, int(at.timestamp() * 1000), rng.random() < 0.8, at))
    end = zero + timedelta(days=40)
    tick = ("tick", 999, "submit", int(end.timestamp() * 1000), False, end)
    after = ("j1", 1000, "submit", int(end.timestamp() * 1000), False, end)  # its state has gone, so that it begins anew
    events += [tick, after]
    names = [f.split()[0] for f in keyed.JOB_ROW.split(", ")]
    got = run(spark, tmp_path, "jobs", JOB, [events[:30], events[30:31], events[31:100], events[100:]], keyed.jobs)
    got = [r for r in rows(got, *names) if r[1] <= int(end.timestamp() * 1000)]
    assert got == plain_jobs(events, int(end.timestamp() * 1000) - 60_000)
    assert any(r[2] == "retry" for r in got)


def test_retry_delays():
    assert [keyed.retry_ms(k) for k in range(4)] == [30_000, 90_000, 270_000, 810_000]
    assert keyed.job_step("running", 4, "fail", True, 4) == ("error", 4, False) and keyed.job_step("running", 2, "restart", False, 4) == ("interrupted", 2, False)


def test_late_pairs(spark, tmp_path):
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    both = "side string, id long, at timestamp, text string"
    data = [("item", k, t(10 * k), f"title {k}") for k in range(12)]
    data += [("late", k, t(10 * k + d), f"summary {k}") for k, d in ((0, 5), (1, 119), (2, 121), (3, -1), (5, 60), (5, 60), (7, 0), (99, 5))]
    data.sort(key=lambda r: r[2])
    flush = [("item", 1000, t(900), "x"), ("late", 1001, t(900), "x")]
    more = [("item", 1002, t(901), "x"), ("late", 1003, t(901), "x")]

    def make(df):
        items = df.where("side = 'item'").select("id", "at", F.col("text").alias("title"))
        late = df.where("side = 'late'").select("id", F.col("at").alias("done_at"), F.col("text").alias("summary"))
        return incremental.with_late(items, late, "id", "at", "done_at")

    want = [r for r in rows(make(spark.createDataFrame(data, both)), "id", "title", "summary")]
    assert ("0" and (0, "title 0", "summary 0")) in want and (2, "title 2", None) in want and (3, "title 3", None) in want and len(want) == 12
    got = run(spark, tmp_path, "late", both, [data[:7], data[7:], flush, more], make)
    assert [r for r in rows(got, "id", "title", "summary") if r[0] < 1000] == want


def test_once_and_buckets(spark, tmp_path):
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    kind = "k long, v long, ts timestamp"
    got = run(spark, tmp_path, "once", kind, [[(1, 1, t(0)), (2, 2, t(1))], [(1, 3, t(5)), (3, 4, t(6))], [(2, 5, t(7))]], lambda s: incremental.once(s, ["k"], "ts"))
    assert rows(got, "k", "v") == [(1, 1), (2, 2), (3, 4)]

    path = str(tmp_path / "table")
    first = spark.createDataFrame([(k, k % 3, t(k)) for k in range(40)], kind)
    assert len(sinks.upsert_buckets(first, path, ["k"], "ts", 8)) == 8
    files = lambda: {str(f): f.read_bytes() for f in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    assert sinks.upsert_buckets(first, path, ["k"], "ts", 8) == [] and files() == before
    written = sinks.upsert_buckets(spark.createDataFrame([(7, 70, t(100)), (8, 80, t(-1))], kind), path, ["k"], "ts", 8)
    after = files()
    assert len(written) == 1 and {f for f in before if f not in after} == {f for f in before if f"bucket={written[0]}/" in f}
    assert dict(rows(spark.read.parquet(path).where("k in (7, 8)"), "k", "v")) == {7: 70, 8: 2} and spark.read.parquet(path).count() == 40

    source, target = str(tmp_path / "src"), str(tmp_path / "stream")
    for batch in ([(1, 1, t(0)), (2, 1, t(0))], [(1, 2, t(9)), (2, 9, t(-9))]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        incremental.latest_by_bucket(spark.readStream.schema(kind).parquet(source), target, str(tmp_path / "bck"), ["k"], "ts").awaitTermination()
    assert rows(spark.read.parquet(target), "k", "v") == [(1, 2), (2, 1)]


@pytest.mark.parametrize("value,ok", [("2026-01-02", True), ("2026-1-02", False), ("2026-13-01", False), ("20260102", False), ("x", False)])
def test_dates(value, ok):
    assert state.step(("in_review", "a", None), "next_check", value, "a", False, None)[0] == ("ok" if ok else "bad_date")
