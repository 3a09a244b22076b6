"""Objects by ranges, logs that late readers replay, a queue that never overlaps, a quota that all tasks share."""

import pytest
from pyspark.sql import functions as F

from scribeflow.operators.calls import Ledger
from scribeflow.operators.keyed import KeyedTable
from scribeflow.sources import objects, paged
from scribeflow.streaming import joblog


@pytest.mark.parametrize("chunk", [1, 7, 1000, 100_000])
def test_ranges_join_to_their_object(spark, tmp_path, chunk):
    bodies = {"a/b c.m4a": bytes(range(256)) * 9, "é": b"x" * 3000, "one": b"1", "none": b""}
    sizes = chunk if chunk > 1 else 1
    bodies = {k: v[:40] if chunk == 1 else v for k, v in bodies.items()}
    rows = spark.createDataFrame([*bodies.items(), (None, b"lost")], "key string, body binary")
    made = objects.put(rows, str(tmp_path / "o"))
    assert {r.key: r["size"] for r in made.collect()} == {k: len(v) for k, v in bodies.items()}
    got = objects.chunks(made, str(tmp_path / "o"), sizes).collect()
    for k, v in bodies.items():
        own = sorted((r.part, r.first, r.length, bytes(r.bytes)) for r in got if r.key == k)
        assert b"".join(p[3] for p in own) == v and all(len(p[3]) == p[2] <= sizes for p in own)


def test_only_the_range_is_read(spark, tmp_path):
    objects.put(spark.createDataFrame([("k", "0123456789"), ("n", None)], "key string, body string"), str(tmp_path / "o"))
    asked = spark.createDataFrame([("k", 3, 4), ("k", 8, 9), ("k", 50, 2), ("k", 0, 0), ("missing", 0, 5), (None, 0, 1), ("n", 0, 5)], "key string, first long, length long")
    assert [bytes(r.bytes) if r.bytes is not None else None for r in objects.read_ranges(asked.coalesce(1), str(tmp_path / "o")).collect()] == [b"3456", b"89", b"", b"", None, None, b""]


def test_answers_to_requests(spark, tmp_path):
    made = objects.put(spark.createDataFrame([("a.m4a", "0123456789"), ("b.wav", "x")], "key string, body string"), str(tmp_path / "o"))
    asked = [(1, "a.m4a", None), (2, "a.m4a", "bytes=2-4"), (3, "a.m4a", "bytes=7-"), (4, "a.m4a", "items=1-2"), (5, "b.wav", None), (6, "c.m4a", "bytes=0-1"), (7, "../a.m4a", None)]
    got = {r.id: (r.status, r.content_range, bytes(r.bytes) if r.bytes is not None else None) for r in objects.answers(spark.createDataFrame(asked, "id long, key string, header string"), made, str(tmp_path / "o")).collect()}
    assert got == {1: (200, None, b"0123456789"), 2: (206, "bytes 2-4/10", b"234"), 3: (206, "bytes 7-9/10", b"789"), 4: (200, None, b"0123456789"), 5: (404, None, None), 6: (404, None, None), 7: (404, None, None)}


def lines_of(spark, folder, job, checkpoint, sink):
    joblog.register(spark)
    rows = spark.readStream.format("job_logs").option("folder", folder).option("job", job).load()
    rows.writeStream.foreachBatch(lambda batch, _: sink.extend((r.line, r.type, r.text) for r in batch.orderBy("line").collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_early_and_late_readers_get_every_line_once(spark, tmp_path):
    folder, early, late = str(tmp_path / "logs"), [], []
    want = []
    for part in range(3):
        log = joblog.LogWriter(folder, "job 1/x")
        for i in range(4 * part + 1):
            log.write(f"line {part}.{i}\nwith a break")
            want.append(("stdout", f"line {part}.{i}\nwith a break"))
        log.flush()
        lines_of(spark, folder, "job 1/x", str(tmp_path / "early"), early)
    with pytest.raises(RuntimeError), joblog.LogWriter(folder, "job 1/x"):
        raise RuntimeError("broken")
    want += [("stderr", "broken"), ("error", "1")]
    lines_of(spark, folder, "job 1/x", str(tmp_path / "early"), early)
    lines_of(spark, folder, "job 1/x", str(tmp_path / "late"), late)
    assert early == late == [(i, *w) for i, w in enumerate(want)]
    some = spark.read.format("job_logs").option("folder", folder).option("start", 5).load()
    assert sorted(r.line for r in some.collect()) == list(range(5, len(want))) and {r.job for r in some.collect()} == {"job 1/x"}
    assert spark.read.format("job_logs").option("folder", str(tmp_path / "none")).load().count() == 0


def test_jobs_of_a_queue_run_in_turn(spark, tmp_path):
    folder = str(tmp_path / "logs")
    keys = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "key string, at long")
    queue = Ledger.create(keys, f"file://{tmp_path}/q", 2, attempts=1, serial=True)
    held = queue.claim(10, 9)
    assert [r.key for r in held.collect()] == ["c"] and queue.claim(11, 9).isEmpty()  # another runner has to wait
    queue.report(held.select("key", F.lit(None).cast("string").alias("error"), F.lit("x").alias("partial")), 12)

    def work(job, log):
        import time

        log.write(f"from {time.time()}")
        time.sleep(0.2)
        if job == "b":
            raise ValueError("no audio")
        log.write(f"to {time.time()}")

    assert joblog.run_queue(queue, folder, work) == 2
    rows = {j: sorted((r.line, r.type, r.text) for r in spark.read.format("job_logs").option("folder", folder).option("job", j).load().collect()) for j in "ab"}
    assert float(rows["a"][1][2].split()[1]) < float(rows["b"][0][2].split()[1])  # in order, never side by side
    assert rows["a"][2][1:] == ("done", "0") and [r[1:] for r in rows["b"][1:]] == [("stderr", "no audio"), ("error", "1")]
    assert {r.key: r.state for r in queue.rows().collect()} == {"a": "completed", "b": "failed", "c": "completed"}


ROWS = {"a": 23, "b": 0, "c": 7, "d": 40}


@pytest.mark.parametrize("probe", [False, True])
def test_a_quota_is_shared_and_the_next_run_goes_on(spark, tmp_path, probe, monkeypatch):
    import os

    folder = tmp_path / "asked"
    folder.mkdir()
    name = f"canned_registry_{int(probe)}"
    module = tmp_path / f"{name}.py"
    module.write_text(f"import os, uuid\nROWS = {ROWS!r}\ndef note():\n    open(os.path.join({str(folder)!r}, uuid.uuid4().hex), 'w').close()\n"
                      "def fetch(category, offset, limit, where):\n    note()\n    return [{'id': f'{category}{i}'} for i in range(ROWS[category])][offset:offset + limit]\n"
                      "def total(category, where):\n    note()\n    return ROWS[category]\n")  # fmt: skip
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(module))
    paged.register(spark)
    progress = KeyedTable.create(spark.createDataFrame([], paged.PROGRESS), f"file://{tmp_path}/p", ["category"], 2)
    options = {"fetch": f"{name}.fetch", "categories": "a,b,c,d", "page_size": "5", "most": "30", "columns": "id string", "pages": "2"} | ({"probe": f"{name}.total"} if probe else {})
    seen, runs = [], 0
    while runs < 12:
        before = len(os.listdir(folder))
        rows = paged.harvest(spark, options, progress, quota=4)
        made = len(os.listdir(folder)) - before
        assert made <= 4
        seen += [(r.category, r.place, r.id) for r in rows.collect()]
        runs += 1
        if all(r.complete for r in progress.rows().collect()) and progress.rows().count() == 4:
            break
    want = {(c, i, f"{c}{i}") for c, n in ROWS.items() for i in range(min(n, 30))}
    assert set(seen) == want and len(seen) == len(want)
    assert {r.category: r.next for r in progress.rows().collect()} == {c: min(n, 30) for c, n in ROWS.items()}
    assert paged.harvest(spark, options, progress, quota=4).count() == 0


def test_a_read_of_all_jobs_has_no_task_a_job(spark, tmp_path):
    folder = str(tmp_path / "logs")
    jobs = [f"job {i}/é" for i in range(400)]
    for job in jobs:
        log = joblog.LogWriter(folder, job)
        log.write(f"of {job}")
        log.write("end")
        log.flush()
    joblog.register(spark)
    rows = spark.read.format("job_logs").option("folder", folder).option("start", 1).load()
    assert rows.rdd.getNumPartitions() <= joblog.FOLDERS < len(jobs)
    assert sorted(map(tuple, rows.collect())) == sorted((j, 1, "stdout", "end") for j in jobs)
    one = spark.read.format("job_logs").option("folder", folder).option("job", jobs[7]).load()
    assert sorted(map(tuple, one.collect())) == [(jobs[7], 0, "stdout", f"of {jobs[7]}"), (jobs[7], 1, "stdout", "end")]
