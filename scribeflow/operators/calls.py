"""Calls to services from tasks: a bounded number at once, an outcome for each row, and a ledger of attempts.

settled asks a service for each row. Rows of a task are asked side by side, at
most so many at once, and each ends in a value or an error, so a row that fails
costs no other. Ledger keeps, in a stored table, what became of each key:
attempts, the time before which it isn't tried again, errors, and partial
results, so a run that is killed goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from scribeflow.operators.keyed import KeyedTable, bucket_of, last_per_key
from scribeflow.operators.snapshots import Conflict
from scribeflow.runtime import Scratch, tasks_for, written


def settled(rows: DataFrame, call: Callable, arguments: list[str], result: str, at_once: int = 8, tasks: int | None = None) -> DataFrame:
    """rows with value (of type result) and error (null, or what went wrong): call of each row's arguments.

    A task has at most at_once calls open; with tasks, the rows are dealt to so many tasks, so that no more than
    tasks * at_once calls are open in all. Rows of a task keep their order and number. A value that isn't of the result's type
    is an error of its row. Without rows nothing is called. Like every task, one that is lost asks again: calls should be safe to repeat.
    """
    kind = StructType([*rows.schema.fields, *StructType.fromDDL(f"value {result}").fields, StructField("error", StringType())])
    out = to_arrow_schema(kind)
    places = [rows.columns.index(a) for a in arguments]
    of = out.field("value").type

    def typed(values: list, errors: list) -> tuple[pa.Array, pa.Array]:
        try:
            found = pa.array(values, of)
        except Exception:  # some aren't of the type: which?
            for i, v in enumerate(values):
                try:
                    values[i] = pa.scalar(v, of).as_py()
                except Exception as e:
                    values[i], errors[i] = None, _says(e)
            found = pa.array(values, of)
        return found, pa.array(errors, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for part in (b.slice(i, 64 * at_once) for i in range(0, b.num_rows, 64 * at_once)):
                    own = list(zip(*(part.column(p).to_pylist() for p in places), strict=True))
                    values, errors, turns = [None] * len(own), [None] * len(own), iter(range(len(own)))

                    def some(own=own, values=values, errors=errors, turns=turns) -> None:  # to hand a thread each row costs more than a short call
                        for i in turns:
                            try:
                                values[i] = call(*own[i])
                            except Exception as e:
                                errors[i] = _says(e)

                    for done in [pool.submit(some) for _ in range(min(at_once, len(own)))]:
                        done.result()
                    yield pa.RecordBatch.from_arrays([*part.columns, *typed(values, errors)], schema=out)

    return (rows.repartition(tasks) if tasks else rows).mapInArrow(run, kind)


def _says(e: Exception) -> str:
    return (str(e) or type(e).__name__)[:500]


#: Claims of more keys than this go bucket by bucket; calls that a task makes, and keys of a bucket, about.
LARGE, EACH, BUCKET = 10_000, 20_000, 100_000
#: Parts of a bucket's keys that wait equally long, of which a large claim takes whole ones but for the last.
PARTS = 64
#: Spans of times that the ledger's list tells of a bucket at most.
SPANS = 8

#: A key of a ledger: pending, running, retry, completed or failed; times in seconds.
LEDGER = "key string, state string, attempts int, not_before long, lease long, error string, partial string"


class _Claim(NamedTuple):
    """Keys of a claim (key, attempts, partial) and their number; of a large one also the files that it wrote, by bucket, and their other rows."""

    keys: DataFrame
    n: int
    files: dict[str, str] | None = None
    others: DataFrame | None = None


class Ledger:
    """Attempts by key in a stored table. Of two runs that claim at once one has to claim again.

    A claimed key that isn't reported before its lease ends counts as one more failed attempt: its run was lost.
    Keys that are added again keep their state; null keys are left out. With serial, nothing is claimed while a key
    runs, and one at a time, in order of arrival (column at of the keys; else of the keys themselves).
    """

    def __init__(self, table: KeyedTable, attempts: int = 3, cooldown: int = 120, lease: int = 7200, serial: bool = False):
        self.table, self.attempts, self.cooldown, self.lease, self.serial = table, attempts, cooldown, lease, serial
        table.note = _waits

    @staticmethod
    def create(keys: DataFrame, folder: str, buckets: int = 16, **rules) -> Ledger:
        """A ledger of pending keys (key; at: the time before which they aren't tried), in so many buckets or, for very many keys, more."""
        buckets = max(buckets, -(-keys.count() // BUCKET))
        return Ledger(KeyedTable.create(_pending(keys), folder, ["key"], buckets, _waits), **rules)

    def add(self, keys: DataFrame) -> int:
        """New keys, pending."""
        return self.table.insert_ignore(_pending(keys))

    def rows(self) -> DataFrame:
        return self.table.rows()

    def claim(self, now: int, most: int) -> DataFrame:
        """At most most keys (key, attempts, partial) whose time has come, those waiting longest first; they are running from now on.

        Of keys that wait equally long a small claim takes them by key, a large one bucket by bucket, so that it changes few buckets.
        Only buckets are read that can hold such keys, as the ledger's list tells.
        """
        claimed = self._claim(now, most)
        return claimed.keys if claimed.files is None else written(claimed.keys, "claim")

    def _claim(self, now: int, most: int) -> _Claim:
        """A claim; a large one's keys are still to be read from the files before it."""
        while True:
            self.table.pin()
            if self.serial:
                most = 1 if self.rows().where((F.col("state") == "running") & (F.col("lease") > now)).isEmpty() else 0
            listed = self.table.log.read(self.table.pinned)[1]
            need, sure = self._buckets(now, most, listed)
            files = {b: name for b, name in listed["files"].items() if b in need}
            if not files:
                return _Claim(self.table.rows_of({}).select("key", "attempts", "partial"), 0)
            try:
                return self._claim_many(now, most, files, sure, listed.get("notes", {})) if most > LARGE else self._claim_few(now, most, files)
            except Conflict:  # someone else claimed meanwhile: look again
                continue

    def _buckets(self, now: int, most: int, listed: dict) -> tuple[set[str], list[tuple] | None]:
        """The buckets that can hold the most keys that wait longest, keys whose run was lost, or such as are given up; and the order
        of the first, as (time, bucket, keys), if the list tells it exactly."""
        notes = listed.get("notes", {})
        place = lambda at, b: (at, int(b) if most > LARGE else 0)
        sure, need = [], {b for b in listed["files"] if b not in notes}
        for b, (lease, tries, spans) in notes.items():
            if lease is not None and lease <= now or spans and spans[0][0] <= now and tries >= self.attempts:
                need.add(b)
            else:
                sure += [(*place(hi, b), n) for _, hi, n in spans if hi <= now]
        sure.sort()
        so_far = list(accumulate(n for *_, n in sure))
        last = next((sure[i][:2] for i, n in enumerate(so_far) if n >= most), None)
        waits = {b: [x for x in spans if x[0] <= now and (last is None or place(x[0], b) <= last)] for b, (_, _, spans) in notes.items()}
        exact = not need and all(lo == hi for spans in waits.values() for lo, hi, _ in spans)
        return need | {b for b, spans in waits.items() if spans}, sure if exact else None

    def _states(self, now: int) -> tuple[Column, Column, Column]:
        """Of a row: its attempts, with one that was lost; whether it can be claimed; whether it is given up."""
        lost = (F.col("state") == "running") & (F.col("lease") <= now)
        tried = F.when(lost, F.col("attempts") + 1).otherwise(F.col("attempts"))
        ready = F.coalesce(lost | (F.col("state").isin("pending", "retry") & (F.col("not_before") <= now)), F.lit(False))
        return tried, ready & (tried < self.attempts), ready & (tried >= self.attempts)

    def _claim_few(self, now: int, most: int, files: dict[str, str]) -> _Claim:
        tried, can, worn = self._states(now)
        rows = self.table.rows_of(files)
        chosen = written(rows.where(can).withColumn("attempts", tried).orderBy("not_before", "key").limit(most), "claim")
        none = F.lit(None).cast("long")
        given_up = rows.where(worn).select("key", F.lit("failed").alias("state"), tried.alias("attempts"), "not_before", none.alias("lease"), F.lit("lost").alias("error"), "partial")
        running = chosen.select("key", F.lit("running").alias("state"), "attempts", "not_before", F.lit(now + self.lease).cast("long").alias("lease"), "error", "partial")
        self.table.upsert(written(given_up.unionByName(running), "claimed"), pinned=True)
        return _Claim(chosen.select("key", "attempts", "partial"), chosen.count())

    def _claim_many(self, now: int, most: int, files: dict[str, str], sure: list[tuple] | None, notes: dict) -> _Claim:
        tried, can, worn = self._states(now)
        rows, after = self.table.rows_of(files), None
        if sure is None:  # keys that were lost, or very many times
            first, n = self._longest(rows.where(can), most)
            if not n and rows.where(worn).isEmpty():
                return _Claim(rows.select("key", "attempts", "partial").limit(0), 0)
        else:
            first, n, after = self._known(now, most, files, sure, notes, can)
        marked = rows.withColumn("_is", F.when(worn, "failed").when(can & first, "running"))  # once: code that repeats it grows too large to be compiled
        taken, others = F.col("_is") == "running", F.coalesce(F.col("_is") != "running", F.lit(True))
        columns = {
            "state": F.coalesce("_is", "state"),
            "attempts": F.when(F.col("_is").isNotNull(), tried).otherwise(F.col("attempts")),
            "lease": F.when(taken, F.lit(now + self.lease).cast("long")).when(F.col("_is").isNull(), F.col("lease")),
            "error": F.when(F.col("_is") == "failed", "lost").otherwise(F.col("error")),
        }
        version = self.table.swap(files, marked.withColumns(columns), moved=False, notes=after, pinned=True)
        keys = marked.where(taken).select("key", tried.alias("attempts"), "partial").repartition(tasks_for(rows.sparkSession, n, EACH), "key")
        now_files = self.table.log.read(version)[1]["files"]
        return _Claim(keys, n, {b: now_files[b] for b in files}, marked.where(others).withColumns(columns).drop("_is"))

    def _known(self, now: int, most: int, files: dict[str, str], sure: list[tuple], notes: dict, can: Column) -> tuple[Column, int, dict]:
        """As _longest where the list tells which buckets are taken, so that only the last one is looked at; and their notes after that."""
        so_far = list(accumulate(n for *_, n in sure))
        k = next((i for i, n in enumerate(so_far) if n >= most), None)
        lease = lambda b: min(x for x in (notes[b][0], now + self.lease) if x is not None)
        if k is None:
            later = {b: [x for x in notes[b][2] if x[0] > now] for b in files}
            return F.lit(True), so_far[-1], {b: (lease(b), notes[b][1] if later[b] else None, later[b]) for b in files}
        at, b, own = sure[k]
        rest, bucket = own - (so_far[k] - most), bucket_of(self.table.by, self.table.buckets)
        # A list, unlike a number, is no part of the code that Spark generates, which thus is the same for each claim and compiled once.
        among = lambda some: F.array_contains(F.array(*map(F.lit, some)).cast("array<int>"), bucket)
        before, same = F.col("not_before") == at, (F.col("not_before") == at) & among([b])
        before = (F.col("not_before") < at) | before & among(sorted(int(x) for x in files if int(x) < b))
        left = {x: [(lo, hi, so_far[k] - most if (lo, int(x)) == (at, b) else m) for lo, hi, m in notes[x][2] if lo > now or (lo, int(x)) > (at, b) or (lo, int(x)) == (at, b) and rest < own] for x in files}
        after = {x: (lease(x), notes[x][1] if left[x] else None, left[x]) for x in files}
        if rest == own:
            return before | same, most, after
        there = self.table.rows_of({str(b): files[str(b)]}).where(can & same)
        return before | same & (self._edge(there, rest) if own <= 2 * BUCKET else self._longest(there, rest)[0]), most, after

    def _edge(self, rows: DataFrame, most: int) -> Column:
        """What holds of the first most rows by key."""
        return F.col("key") <= rows.select("key").orderBy("key").limit(most).agg(F.max("key")).first()[0]

    def _longest(self, rows: DataFrame, most: int) -> tuple[Column, int]:
        """What holds of the most rows that wait longest, and their number: but for a part of a bucket they are never sorted."""
        bucket, part = bucket_of(self.table.by, self.table.buckets), F.pmod(F.xxhash64("key", F.lit("part")), F.lit(PARTS))
        place = ["not_before", "_b", "_p"]
        heads = rows.withColumns({"_b": bucket, "_p": part}).groupBy(place).agg(F.count("*").alias("n")).orderBy(place).limit(most)  # each has a row or more
        so_far = heads.withColumn("_upto", F.sum("n").over(W.orderBy(*place)))
        last, n = so_far.agg(F.min(F.when(F.col("_upto") >= most, F.struct("_upto", "n", *place))), F.coalesce(F.max("_upto"), F.lit(0))).first()
        if last is None:
            return F.lit(True), n
        wait, same = F.lit(last["not_before"]), (F.col("not_before") == last["not_before"]) & (bucket == last["_b"])
        before = (F.col("not_before") < wait) | (F.col("not_before") == wait) & (bucket < last["_b"]) | same & (part < last["_p"])
        rest, own = most - (last["_upto"] - last["n"]), same & (part == last["_p"])
        if rest == last["n"]:
            return before | own, most
        return before | own & self._edge(rows.where(own), rest), most

    def report(self, outcomes: DataFrame, now: int) -> int:
        """What became of claimed keys: key, error (null: done), partial (null: as before). A failed key cools down, or is given up."""
        new = last_per_key(outcomes.select("key", F.col("error").alias("_error"), F.col("partial").alias("_partial")), ["key"]).withColumn("_told", F.lit(True))
        columns = [F.when(F.col("_told"), is_).otherwise(F.col(was)).alias(was) for was, is_ in self._became("_error", "_partial", now).items()]
        while True:
            try:
                return self.table.change(outcomes.select("key"), lambda old: old.join(new, "key", "left").select("key", *columns))
            except Conflict:
                continue

    def _became(self, error: str, partial: str, now: int) -> dict[str, Column]:
        """A key's columns after an attempt."""
        tried = F.col("attempts") + 1
        state = F.when(F.col(error).isNull(), "completed").when(tried >= self.attempts, "failed").otherwise("retry")
        return {"state": state, "attempts": tried, "not_before": F.lit(now + self.cooldown).cast("long"), "lease": F.lit(None).cast("long"), "error": F.col(error), "partial": F.coalesce(partial, "partial")}

    def _ended(self, claimed: _Claim, ends: DataFrame, now: int) -> None:
        """As report, of all keys of a claim (key, attempts, partial, error, value): its buckets are put together anew, if nobody changed them."""
        if claimed.files:
            told = ends.select("key", *[c.alias(name) for name, c in self._became("error", "value", now).items()])
            try:
                self.table.swap(claimed.files, claimed.others.unionByName(told))
                return
            except Conflict:
                pass
        self.report(ends.select("key", "error", F.col("value").alias("partial")), now)

    def run(self, call: Callable, batch: int = 100, at_once: int = 8, tasks: int | None = None, limit: int | None = None, clock: Callable[[], float] = time.time, wait: Callable[[float], None] | None = None) -> int:
        """Claims, calls and reports until no key is ready, or until limit seconds have passed (what runs is finished first).

        call(key, attempts, partial) gives the partial result to keep, or raises. With wait, keys that cool down are
        waited for. Returns how many attempts were made.
        """
        began, made = clock(), 0
        while limit is None or clock() - began < limit:
            claimed = self._claim(int(clock()), batch)
            if not claimed.n:
                later = self.rows().where("state = 'retry'").agg(F.min("not_before")).first()[0]
                if wait is None or later is None:
                    break
                wait(max(0, later - clock()))
                continue
            kept = Scratch(self.table.spark)
            ends = kept.written(settled(claimed.keys, call, ["key", "attempts", "partial"], "string", at_once, tasks), "ends")
            made += claimed.n
            self._ended(claimed, ends, int(clock()))
            kept.clear()
        return made


def _waits(rows: DataFrame) -> dict[str, tuple]:
    """Of each bucket: when the first lease of its running keys ends, the most attempts of those that wait, and spans (from, to, keys) of the times they wait for.

    Up to SPANS different times have a span each, more of them share spans.
    """
    waiting = F.col("state").isin("pending", "retry")
    times = rows.groupBy("_b", F.when(waiting, F.col("not_before")).alias("at")).agg(F.min(F.when(F.col("state") == "running", F.col("lease"))).alias("lease"), F.max(F.when(waiting, F.col("attempts"))).alias("tries"), F.count("*").alias("n"))
    span = F.ntile(SPANS).over(W.partitionBy("_b", F.isnull("at")).orderBy("at"))
    found = times.withColumn("_s", span).groupBy("_b", "_s", F.isnull("at")).agg(F.min("lease").alias("lease"), F.max("tries").alias("tries"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("n").alias("n"))
    out: dict[str, tuple] = {}
    for r in found.orderBy("_b", "lo").collect():  # SPANS + 1 a bucket at most
        lease, tries, spans = out.get(str(r["_b"]), (None, None, []))
        tries = max((x for x in (tries, r["tries"]) if x is not None), default=None)
        out[str(r["_b"])] = (r["lease"] if lease is None else lease, tries, [*spans, (r["lo"], r["hi"], r["n"])] if r["lo"] is not None else spans)
    return out


def _pending(keys: DataFrame) -> DataFrame:
    at = F.col("at").cast("long") if "at" in keys.columns else F.lit(0).cast("long")
    own = keys.select(F.col("key").cast("string"), at.alias("at")).where("key IS NOT NULL").groupBy("key").agg(F.coalesce(F.min("at"), F.lit(0)).alias("at"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return own.select("key", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.col("at").cast("long").alias("not_before"), none("long", "lease"), none("string", "error"), none("string", "partial"))
