"""Admission by sliding window: a request passes if fewer than limit passed in the window before it.

Rejected requests don't count, so each decision depends on those before it: no
window aggregate gives it. Each key's requests are folded in order in bounded
state: the times of the last limit admitted ones.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scribeflow.runtime import tasks_for


class Gate:
    """The admitted times of one key within the window."""

    def __init__(self, limit: int, window_s: int, times=()):
        self.limit, self.window_s, self.times = limit, window_s, deque(times)

    def admit(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.window_s:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def admitted(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """key, at, event_id, admitted of requests (key, at in seconds, event_id), in order of time and id.

    Requests are sorted by key and time within partitions and folded as they
    come, so a key with very many takes no more memory than one with few.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL("key string, at long, event_id long, admitted boolean")
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gate = None, Gate(limit, window_s)
        for b in batches:
            flags = []
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    key, gate = k, Gate(limit, window_s)
                flags.append(gate.admit(at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(flags)], schema=out)

    rows = requests.select("key", "at", "event_id").where("key IS NOT NULL AND at IS NOT NULL")
    parts = tasks_for(requests.sparkSession, rows.count(), 5_000_000)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, kind)


def first_per_key(requests: DataFrame) -> DataFrame:
    """key, at, event_id, events: the first request of each key, by time and id, and the number of all."""
    first = F.min(F.struct("at", "event_id")).alias("f")
    return requests.groupBy("key").agg(first, F.count("*").alias("events")).select("key", "f.at", "f.event_id", "events")


def admitted_stream(requests: DataFrame, limit: int, window_s: int, late_s: int = 60) -> DataFrame:
    """admitted for a stream (at: seconds). A key's state, at most limit times, goes once its window has passed.

    Requests that come more than late_s behind the newest are dropped by the watermark.
    """

    def decide(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(frames)).sort_values(["at", "event_id"])
        gate = Gate(limit, window_s, state.get[0] if state.exists else ())
        own["admitted"] = [gate.admit(int(t)) for t in own["at"]]
        state.update((list(gate.times),))
        last = max([int(own["at"].iloc[-1]), *gate.times])
        state.setTimeoutTimestamp(max((last + window_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield own[["key", "at", "event_id", "admitted"]]

    rows = requests.select("key", "at", "event_id", F.timestamp_seconds("at").alias("_ts")).withWatermark("_ts", f"{late_s} seconds")
    return rows.groupBy("key").applyInPandasWithState(decide, "key string, at long, event_id long, admitted boolean", "times array<long>", "append", "EventTimeTimeout")
