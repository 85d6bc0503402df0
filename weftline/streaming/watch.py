"""Watching work that runs: operational events of streams to bounded sinks, and budgets that stop a job once it passes them.

Neither changes what a job writes. A sink that fails or is full loses events, never a record, and what was lost is counted.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from weftline.operators.contracts import WORKFLOW

#: What operators.contracts.events_judged judges, with an id and the run; at: milliseconds since 1970.
EVENT = "event_id string, run_id string, at long, event_type string, component string, status string, reason_code string, item_count long, duration_ms long"
#: How many failures of sinks are kept whole; all are counted.
MOST_FAILURES = 256


def event(run: str, event_type: str, component: str, status: str, reason: str | None = None, items: int = 0, duration_ms: int | None = None) -> Row:
    return Row(event_id=uuid.uuid4().hex, run_id=run, at=int(time.time() * 1000), event_type=event_type, component=component, status=status, reason_code=reason, item_count=items, duration_ms=duration_ms)


class Dispatcher:
    """Hands each event to every sink and to the handlers of its type and of "*". A failure of one reaches no other and not the caller."""

    def __init__(self, most_failures: int = MOST_FAILURES) -> None:
        self._handlers: list[tuple[str, Callable[[Row], None]]] = []
        self._most, self._lock = most_failures, threading.Lock()
        self.failures: list[tuple[str, str, str]] = []
        self.failure_count = 0

    def on(self, event_type: str, handler: Callable[[Row], None]) -> Dispatcher:
        self._handlers.append((event_type, handler))
        return self

    def emit(self, made: Row) -> None:
        for wanted, handler in list(self._handlers):
            if wanted not in ("*", made["event_type"]):
                continue
            try:
                handler(made)
            except Exception as error:
                with self._lock:
                    self.failure_count += 1
                    if len(self.failures) < self._most:
                        self.failures.append((made["event_id"], getattr(handler, "__qualname__", type(handler).__name__), type(error).__name__))


class BoundedEvents:
    """Events that wait to be written: at most `most`, later ones are dropped and counted."""

    def __init__(self, most: int = 256) -> None:
        if most <= 0:
            raise ValueError("a queue holds at least one event")
        self._queue: queue.Queue[Row] = queue.Queue(most)
        self._lock = threading.Lock()
        self.dropped = 0

    def put(self, made: Row) -> None:
        """A handler for Dispatcher.on."""
        try:
            self._queue.put_nowait(made)
        except queue.Full:
            with self._lock:
                self.dropped += 1

    def drain(self, spark: SparkSession) -> DataFrame:
        """The events that wait, in order, as rows; they do not wait any more."""
        rows = []
        for _ in range(self._queue.maxsize):
            try:
                rows.append(self._queue.get_nowait())
            except queue.Empty:
                break
        return spark.createDataFrame([tuple(r) for r in rows], EVENT)


class StreamEvents(StreamingQueryListener):
    """The life of streaming queries as operational events: started, one summary for each micro-batch, completed. `only`: names of
    queries; without it all of the session. component: the stage whose work the batches are."""

    def __init__(self, dispatcher: Dispatcher, component: str = "destination_delivery", only: set[str] | None = None) -> None:
        super().__init__()
        self._to, self._component, self._only, self._known = dispatcher, component, only, {}

    def onQueryStarted(self, event_) -> None:  # noqa: N802
        if self._only is None or event_.name in self._only:
            self._known[str(event_.runId)] = event_.name
            self._to.emit(event(str(event_.runId), "workflow_started", WORKFLOW, "started"))

    def onQueryProgress(self, event_) -> None:  # noqa: N802
        p = event_.progress
        if str(p.runId) in self._known:
            self._to.emit(event(str(p.runId), "stage_summary", self._component, "passed", items=int(p.numInputRows), duration_ms=int(p.batchDuration)))

    def onQueryTerminated(self, event_) -> None:  # noqa: N802
        if self._known.pop(str(event_.runId), self) is not self:
            failed = event_.exception is not None
            self._to.emit(event(str(event_.runId), "workflow_completed", WORKFLOW, "failed" if failed else "passed", "workflow_stage_failed" if failed else None))


def append_events(events: DataFrame, path: str) -> int:
    """Appends drained events to a folder of JSON lines, one job for a bounded list; how many."""
    rows = events.collect()
    if rows:
        lines = [(json.dumps(r.asDict(), sort_keys=True),) for r in rows]
        events.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)
    return len(rows)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


# ---- budgets

R = TypeVar("R")


@dataclass(frozen=True)
class Budget:
    """What a piece of work may read and how long it may take; None: no bound."""

    max_total_records: int | None = None
    max_total_bytes: int | None = None
    wall_timeout_seconds: float | None = None

    def __post_init__(self) -> None:
        if any(v is not None and v <= 0 for v in self.__dict__.values()):
            raise ValueError("budgets are positive")


class BudgetExceeded(RuntimeError):
    def __init__(self, which: str, records: int, read: int, seconds: float) -> None:
        super().__init__(f"{which}: {records} records, {read} bytes, {seconds:.1f} s")
        self.which, self.records, self.read, self.seconds = which, records, read, seconds


class _Meter:
    """What the jobs of a tag have read until now, by the driver's own metrics of their stages: all tasks that have ended, and
    those that run by their last heartbeat. Stages that were taken over from other jobs count once."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self._context, self._tag = spark.sparkContext._jsc.sc(), tag
        self._start = time.monotonic()

    def used(self) -> tuple[int, int, float]:
        tracker, store = self._context.statusTracker(), self._context.statusStore()
        stages = set()
        for job in tracker.getJobIdsForTag(self._tag):
            info = tracker.getJobInfo(job)
            stages |= set(info.get().stageIds()) if info.isDefined() else set()
        records = read = 0
        for stage in stages:
            if tracker.getStageInfo(stage).isDefined():
                data = store.lastStageAttempt(stage)
                records, read = records + data.inputRecords(), read + data.inputBytes()
        return records, read, time.monotonic() - self._start


def _passed(budget: Budget, used: tuple[int, int, float]) -> str | None:
    bounds = zip(("max_total_records", "max_total_bytes", "wall_timeout_seconds"), used, strict=True)
    return next((name for name, value in bounds if getattr(budget, name) is not None and value > getattr(budget, name)), None)


def run_within(spark: SparkSession, work: Callable[[], R], budget: Budget, every: float = 0.2) -> R:
    """Runs work, whose Spark jobs start in this thread, within a budget: once its jobs have read more than that, or it takes longer,
    they are cancelled and BudgetExceeded names the bound. Work that ends before it is noticed fails all the same, so the outcome
    does not depend on timing, though what it wrote by then stands. What is counted is what scans read, filters at the scan applied.
    """
    context = spark.sparkContext
    tag = f"budget-{uuid.uuid4().hex}"
    meter, done, broken = _Meter(spark, tag), threading.Event(), []

    def watch() -> None:
        while not done.wait(every):
            used = meter.used()
            which = _passed(budget, used)
            if which:
                broken.append(BudgetExceeded(which, *used))
                context.cancelJobsWithTag(tag)
                # Jobs that the work starts after this are cancelled too.
                while not done.wait(every):
                    context.cancelJobsWithTag(tag)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        out = work()
    except Exception as error:
        if broken:
            raise broken[0] from error
        raise
    finally:
        context.removeJobTag(tag)
        done.set()
        watcher.join()
    used = meter.used()
    which = _passed(budget, used)
    if broken or which:
        raise broken[0] if broken else BudgetExceeded(which, *used)
    return out
