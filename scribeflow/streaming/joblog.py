"""Logs of jobs that can be read from the start at any time, and a queue that runs one job after another.

A job's lines lie in small files named by the number of their first line, each
put in place whole. A stream over a job's log has the next line's number as its
offset: a late reader starts at 0 and gets every line in order, an early one
goes on where it stopped; both end up with the same lines, each once.

Jobs lie in a fixed number of folders by a hash of their name, and a batch read of
all jobs has a task for each such folder, which lists and reads its own jobs: the
driver meets no names of jobs, and tasks don't grow in number with them.

The queue is a ledger that gives out one key at a time, in order of arrival, to whoever asks
first; so jobs never overlap, however many runners there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote
from zlib import crc32

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from scribeflow.operators.calls import Ledger

LINES = "job string, line long, type string, text string"
#: Lines of a file; folders that jobs are dealt to.
FLUSH, FOLDERS = 500, 256


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _place(base: str, job: str) -> str:
    return f"{base}/{crc32(job.encode()) % FOLDERS:04x}/{quote(job, safe='')}"


def _files(folder: str, job: str) -> list[tuple[int, int, str]]:
    """(first line, lines, path) of a job's files, in order; files that go on from another line than the next don't count."""
    store, base = _store(folder)
    found = []
    for f in store.get_file_info(pafs.FileSelector(_place(base, job), allow_not_found=True)):
        stem, dot, kind = f.base_name.rpartition(".")
        if kind == "jsonl":
            first, _, count = stem.partition("-")
            found.append((int(first), int(count), f.path))
    out, at = [], 0
    for first, count, path in sorted(found):
        if first == at:
            out.append((first, count, path))
            at += count
    return out


class LogWriter:
    """Lines of one job, from the number on where its log ends. Used as a context: the end is written with an exit code."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job, self.held = folder, job, []
        self.next = sum(n for _, n, _ in _files(folder, job))

    def write(self, text: str, kind: str = "stdout") -> None:
        self.held.append({"type": kind, "text": text})
        if len(self.held) >= FLUSH:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        store, base = _store(self.folder)
        place = _place(base, self.job)
        store.create_dir(place, recursive=True)
        name = f"{place}/{self.next:012d}-{len(self.held):06d}"
        with store.open_output_stream(f"{name}.part", compression=None) as f:
            f.write("\n".join(map(json.dumps, self.held)).encode())
        store.move(f"{name}.part", f"{name}.jsonl")
        self.next, self.held = self.next + len(self.held), []

    def __enter__(self) -> LogWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.write(str(error)[:500], "stderr")
        self.write("1" if error is not None else "0", "error" if error is not None else "done")
        self.flush()


class _Lines(InputPartition):
    def __init__(self, job: str, path: str, first: int, start: int, end: int):
        super().__init__((job, path))
        self.job, self.path, self.first, self.start, self.end = job, path, first, start, end


class _Jobs(InputPartition):
    """The jobs of one of the folders that jobs are dealt to."""

    def __init__(self, name: str, start: int):
        super().__init__(name)
        self.name, self.start = name, start


def _below(folder: str, name: str = "") -> Iterator[str]:
    store, base = _store(folder)
    return (f.base_name for f in store.get_file_info(pafs.FileSelector(f"{base}/{name}".rstrip("/"), allow_not_found=True)) if f.type == pafs.FileType.Directory)


def _parts(folder: str, job: str, start: int) -> list[_Lines]:
    return [_Lines(job, path, first, start, 1 << 62) for first, n, path in _files(folder, job) if first + n > start]


def _read(part: _Lines | _Jobs | None, folder: str) -> Iterator[tuple]:
    if part is None:  # what Spark reads where there are no partitions
        return
    if isinstance(part, _Jobs):
        for job in map(unquote, _below(folder, part.name)):
            for own in _parts(folder, job, part.start):
                yield from _read(own, folder)
        return
    store, _ = _store(folder)
    with store.open_input_file(part.path) as f:
        lines = f.read().decode().split("\n")
    for i in range(max(part.start, part.first), min(part.end, part.first + len(lines))):
        own = json.loads(lines[i - part.first])
        yield part.job, i, own["type"], own["text"]


class JobLogs(DataSource):
    """Options: folder; job (a stream needs one; without it a batch read takes all jobs); start (the first line wanted: 0)."""

    @classmethod
    def name(cls) -> str:
        return "job_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.job, self.start = options["folder"], options.get("job"), int(options.get("start", 0))

    def partitions(self) -> list[InputPartition]:
        if self.job is not None:
            return _parts(self.folder, self.job, self.start)
        return [_Jobs(name, self.start) for name in sorted(_below(self.folder))]

    def read(self, partition: _Lines | _Jobs) -> Iterator[tuple]:
        return _read(partition, self.folder)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.job, self.start = options["folder"], options["job"], int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"line": self.start}

    def latestOffset(self) -> dict:
        return {"line": max(self.start, sum(n for _, n, _ in _files(self.folder, self.job)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Lines(self.job, path, first, start["line"], end["line"]) for first, n, path in _files(self.folder, self.job) if first < end["line"] and first + n > start["line"]]

    def read(self, partition: _Lines) -> Iterator[tuple]:
        return _read(partition, self.folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobLogs)


def run_queue(queue: Ledger, folder: str, work: Callable[[str, LogWriter], None], limit: int | None = None) -> int:
    """Runs the queue's jobs one after another, in order of arrival, until none waits; work gets a job and its log.

    queue: a ledger with serial. Returns how many attempts were made; a job that raises ends with an error line.
    """

    def call(key: str, attempts: int, partial: str | None) -> str:
        with LogWriter(folder, key) as log:
            work(key, log)
        return "done"

    return queue.run(call, batch=1, at_once=1, limit=limit)
