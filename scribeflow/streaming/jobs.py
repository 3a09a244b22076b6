"""A job for each key: steps one after another, each by a timer, with its own state, error, attempts and cool-down.

A request starts a job unless one of its key runs or is done. The first step
gives the job's segments, which are kept in state in pieces of PIECE; the
others get them. A failed step is tried again after a cool-down, as often as
allowed; then the job has failed, or, if the step is soft, goes on. A later
request starts a failed job anew. So a key that fails costs no other key
anything, and no batch.

The rules are in Machine, which knows nothing of Spark: a stream keeps its Job
in state (transformWithState, RocksDB), and a log of requests is replayed by
folding each key's requests in order of time, with the same rules.

Defined cases: requests without key or time are left out; requests of a key at
one time are taken by id; a timer due when a request comes is run first; a job
without segments goes through its steps with none; a finished job keeps its
status alone; errors are cut to 500 characters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scribeflow.runtime import tasks_for

#: Segments of a piece of state.
PIECE = 500
#: What a job reports: answers to requests (id set), and the end of each attempt at a step.
EVENTS = "key string, at long, id long, step string, state string, error string"


@dataclass(frozen=True)
class Step:
    """run(key, request id, segments) gives the segments (first step) or anything (others); it fails by raising."""

    name: str
    run: Callable[[str, int, list], list | None]
    soft: bool = False


@dataclass(frozen=True)
class Job:
    """What is kept of a key. due: when the step is run next (ms)."""

    status: str = "idle"
    request: int | None = None
    step: int = 0
    tries: int = 0
    due: int | None = None
    error: str = ""


@dataclass(frozen=True)
class Machine:
    """The rules. delay: ms from a request, or the end of a step, to the next step."""

    steps: Sequence[Step]
    delay: int = 0
    attempts: int = 1
    cooldown: int = 0

    def ask(self, job: Job, at: int, request: int) -> tuple[Job, str]:
        """The job after a request, and the answer."""
        if job.status == "processing":
            return job, "already_processing"
        if job.status == "completed":
            return job, "already_exists"
        return Job("processing", request, 0, 0, at + self.delay), "started"

    def advance(self, key: str, job: Job, segments: list, at: int) -> tuple[Job, tuple[str, str, str], list]:
        """Runs the step that is due: the job after it, (step, state, error), and the segments."""
        step, made, error = self.steps[job.step], None, ""
        try:
            made = step.run(key, job.request, segments)
        except Exception as e:
            error = (str(e) or type(e).__name__)[:500]
        if not error:
            if job.step == 0:
                segments = list(made or [])
            state = "completed"
        elif job.tries + 1 < self.attempts:
            return replace(job, tries=job.tries + 1, due=at + self.cooldown, error=error), (step.name, "retry", error), segments
        elif step.soft:
            state = "passed_over"
        else:
            return Job("failed", job.request, job.step, job.tries + 1, None, error), (step.name, "failed", error), []
        if job.step + 1 == len(self.steps):
            return Job("completed", job.request, job.step), (step.name, state, error), []
        return Job("processing", job.request, job.step + 1, 0, at + self.delay), (step.name, state, error), segments


def replayed(requests: DataFrame, machine: Machine) -> DataFrame:
    """EVENTS of a whole log of requests (key, at in ms, id), each key by itself; jobs run to their end.

    Requests are sorted by key and time within partitions and folded as they come: a task holds one job.
    """
    kind = StructType.fromDDL(EVENTS)
    out = to_arrow_schema(kind)

    def due(key: str, job: Job, segments: list, until: int | None) -> Iterator:
        while job.due is not None and (until is None or job.due <= until):
            at = job.due
            job, (step, state, error), segments = machine.advance(key, job, segments, at)
            yield job, segments, (key, at, None, step, state, error)

    def events(rows: Iterator[tuple]) -> Iterator[tuple]:
        here, job, segments = None, Job(), []
        for key, at, request in rows:
            if key != here:
                for _, _, event in due(here, job, segments, None):
                    yield event
                here, job, segments = key, Job(), []
            for job, segments, event in due(key, job, segments, at):
                yield event
            job, answer = machine.ask(job, at, request)
            yield key, at, request, None, answer, ""
        for _, _, event in due(here, job, segments, None):
            yield event

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []
        for event in events(rows):
            held.append(event)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    rows = requests.select(F.col("key").cast("string"), F.col("at").cast("long"), F.col("id").cast("long")).where("key IS NOT NULL AND at IS NOT NULL")
    parts = tasks_for(requests.sparkSession, rows.count(), 5_000_000)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "at", "id").mapInArrow(run, kind)


def last_states(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """key, status, step, error, starts, refused: where each key's job stands, how often it started and how many requests it refused."""
    place = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    ended = events.where("id IS NULL").groupBy("key").agg(F.max_by(F.struct("step", "state", "error"), F.struct("at", place, F.col("state") != "retry")).alias("l"))
    asked = events.where("id IS NOT NULL").groupBy("key").agg(F.count_if(F.col("state") == "started").alias("starts"), F.count_if(F.col("state") != "started").alias("refused"))
    whole = (F.col("l.step") == steps[-1]) & F.col("l.state").isin("completed", "passed_over")
    status = F.when(F.col("l.state") == "failed", "failed").when(whole, "completed").otherwise("processing")
    return asked.join(ended, "key", "left").select("key", status.alias("status"), "l.step", F.when(status == "failed", F.col("l.error")).otherwise("").alias("error"), "starts", "refused")


class _Jobs(StatefulProcessor):
    """Machine with its Job, and its segments in pieces, in the state of a stream."""

    def __init__(self, machine: Machine, by_event: bool):
        self.machine, self.by_event = machine, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, request long, step int, tries int, due long, error string")
        self.pieces = handle.getListState("pieces", "segments string")

    def _load(self) -> Job:
        kept = self.job.get() if self.job.exists() else None
        return Job(*kept) if kept else Job()

    def _segments(self) -> list:
        return [s for piece in self.pieces.get() for s in json.loads(piece[0])] if self.pieces.exists() else []

    def _keep(self, job: Job, segments: list | None) -> None:
        self.job.update((job.status, job.request, job.step, job.tries, job.due, job.error))
        if segments is not None:
            self.pieces.clear()
            if segments:
                self.pieces.put([(json.dumps(segments[i : i + PIECE]),) for i in range(0, len(segments), PIECE)])
        if job.due is not None:
            self.handle.registerTimer(job.due)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.by_event else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = self._load()
        set_before, segments = job.due, None
        for at, request in sorted((r["at"], r["id"]) for r in rows):
            while self.by_event and job.due is not None and job.due <= at:  # the steps that time has come for
                segments = self._segments() if segments is None else segments
                due = job.due
                if due == set_before:
                    self.handle.deleteTimer(due)
                job, event, segments = self.machine.advance(key[0], job, segments, due)
                yield Row(key=key[0], at=due, id=None, step=event[0], state=event[1], error=event[2])
            job, answer = self.machine.ask(job, at if self.by_event else max(at, self._now(timerValues)), request)
            if answer == "started":
                segments = []
            yield Row(key=key[0], at=at, id=request, step=None, state=answer, error="")
        self._keep(job, segments)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if job.due != due:  # an older timer, which was overtaken
            return
        had = self._segments()
        first = job.step == 0
        job, event, segments = self.machine.advance(key[0], job, had, due if self.by_event else self._now(timerValues))
        self._keep(job, segments if first or job.due is None else None)
        yield Row(key=key[0], at=due, id=None, step=event[0], state=event[1], error=event[2])


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(requests: DataFrame, machine: Machine, late: str | None = None) -> DataFrame:
    """EVENTS of a stream of requests (key, at in ms, id); the session's state store must be STORE.

    Timers go by the clock; with late (a delay) they go by the requests' own time, once it is that far behind the newest.
    """
    rows = requests.select(F.col("key").cast("string"), F.col("at").cast("long"), F.col("id").cast("long")).where("key IS NOT NULL AND at IS NOT NULL")
    if late:
        rows = rows.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)
    return rows.groupBy("key").transformWithState(_Jobs(machine, bool(late)), StructType.fromDDL(EVENTS), "append", "EventTime" if late else "ProcessingTime")
