"""Streams with kept state for each key, and timers: hypotheses' lifecycles, and jobs with retries.

State lies in the RocksDB store (set it by use_store() before a query starts). Rows of one trigger are
taken in order of seq, so that the result is the same however events are cut into batches, as long as a
key's events arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwire.operators.state import FOLDED, step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Lifecycle(StatefulProcessor):
    """Folds a hypothesis's events into its state; a row with its result for every event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "lifecycle_status string, owner_username string, next_check_at string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState.lifecycle_status, initialState.owner_username, initialState.next_check_at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.state.exists():
            return  # of no known hypothesis
        now = tuple(self.state.get())
        for e in sorted(rows, key=lambda r: r.seq):
            result, now = step(now, e.kind, e.value, e.caller, e.is_admin, e.confirm)
            yield Row(id=key[0], seq=e.seq, kind=e.kind, result=result, lifecycle_status=now[0], owner_username=now[1], next_check_at=now[2])
        self.state.update(now)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """state.fold() as a stream: hypotheses are the state that it begins with."""
    start = hypotheses.select("id", "lifecycle_status", "owner_username", "next_check_at").groupBy("id")
    return events.groupBy("id").transformWithState(Lifecycle(), FOLDED, "Append", "None", initialState=start)


JOB_ROW = "id string, at_ms long, event string, status string, attempts int"
FINISHED = ("done", "cancelled", "interrupted", "error")
DAY_MS = 86_400_000


def retry_ms(attempt: int) -> int:
    """30, 90, 270, 810 seconds."""
    return 30_000 * 3**attempt


def job_step(status: str | None, attempts: int, event: str, transient: bool, most: int) -> tuple[str | None, int, bool]:
    """(status, attempts, whether a retry is due later) after an event; what does not fit the status changes nothing."""
    if event == "submit" and status is None:
        return "queued", 0, False
    if event == "start" and status == "queued":
        return "running", attempts, False
    if event == "finish" and status == "running":
        return "done", attempts, False
    if event == "fail" and status == "running":
        return ("waiting", attempts + 1, True) if transient and attempts < most else ("error", attempts, False)
    if event == "cancel" and status in ("queued", "waiting"):
        return "cancelled", attempts, False
    if event == "restart" and status == "running":
        return ("queued", attempts + 1, False) if attempts < 2 else ("interrupted", attempts, False)
    return status, attempts, False


class Jobs(StatefulProcessor):
    """A job's status from its events (seq, event, at_ms, transient).

    A failure that may pass sets a timer for the delay of its attempt, which puts the job back into the
    queue; a finished job's state goes after `days`. A timer that is due before an event is taken before
    it, whether or not the watermark has brought it yet, so that batches do not matter.
    """

    def __init__(self, most: int = 4, days: int = 30):
        self.most, self.days = most, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, due long")

    def _due(self, key, status, attempts, due, until) -> Iterator[tuple]:
        """The row and the state of what is due by `until`."""
        if due is not None and due <= until:
            self.handle.deleteTimer(due)
            if status == "waiting":
                yield Row(id=key[0], at_ms=due, event="retry", status="queued", attempts=attempts), ("queued", attempts, None)
            else:
                yield None, None  # long finished

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, attempts, due = tuple(self.state.get()) if self.state.exists() else (None, 0, None)
        for e in sorted(rows, key=lambda r: r.seq):
            for row, after in self._due(key, status, attempts, due, e.at_ms):
                status, attempts, due = after or (None, 0, None)
                if row:
                    yield row
            was = status
            status, attempts, again = job_step(status, attempts, e.event, bool(e.transient), self.most)
            if status != was:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = e.at_ms + retry_ms(attempts - 1) if again else e.at_ms + self.days * DAY_MS if status in FINISHED else None
                if due is not None:
                    self.handle.registerTimer(due)
                yield Row(id=key[0], at_ms=e.at_ms, event=e.event, status=status, attempts=attempts)
        if status is None:
            self.state.clear()
        else:
            self.state.update((status, attempts, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        status, attempts, due = tuple(self.state.get())
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return  # an event has taken it already
        if status == "waiting":
            self.state.update(("queued", attempts, None))
            yield Row(id=key[0], at_ms=due, event="retry", status="queued", attempts=attempts)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def jobs(events: DataFrame, ts: str = "ts", late: str = "1 minute", most: int = 4, days: int = 30) -> DataFrame:
    """Every change of a job's status, from a stream (id, seq, event, at_ms, transient, and ts, the time that at_ms is)."""
    own = events.withWatermark(ts, late)
    return own.groupBy("id").transformWithState(Jobs(most, days), JOB_ROW, "Append", "EventTime")
