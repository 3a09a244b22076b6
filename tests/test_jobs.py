"""Jobs by key: the replayed log and the stream against a plain loop; retries, soft steps, pieces, restarts."""

import json
import random

import pytest

from scribeflow.streaming import jobs

STEPS = ("listen", "store", "sum up", "places", "link")
SCHEMA = "key string, at long, id long"



def steps(counter=None):
    def step(k):
        def run(key, request, segments):
            if k and len(segments) != request % 1300:
                raise AssertionError("segments were lost")
            if (request * 7 + k) % 9 == 0:
                raise ValueError(f"{STEPS[k]} {request}")
            return [{"text": f"{key} {i}", "at": i} for i in range(request % 1300)] if k == 0 else None

        return jobs.Step(STEPS[k], run, soft=STEPS[k] == "places")

    return [step(k) for k in range(len(STEPS))]


def plain(requests, delay, attempts, cooldown, until=None):
    """The events, by a loop over each key's requests."""
    out = []
    for key in {r[0] for r in requests}:
        status, ends, todo = "idle", None, []
        for at, request in sorted((a, i) for k, a, i in requests if k == key):
            if status != "idle" and ends is not None and ends <= at:
                status = todo[-1][0]
                ends = None
            if status in ("running", "completed"):
                out.append((key, at, request, None, "already_processing" if status == "running" else "already_exists", ""))
                continue
            out.append((key, at, request, None, "started", ""))
            now, final = at + delay, "completed"
            for k, name in enumerate(STEPS):
                bad = (request * 7 + k) % 9 == 0
                error = f"{name} {request}" if bad else ""
                for _ in range(attempts - 1 if bad else 0):
                    out.append((key, now, None, name, "retry", error))
                    now += cooldown
                soft = bad and name == "places"
                out.append((key, now, None, name, "passed_over" if soft else "failed" if bad else "completed", error))
                if bad and not soft:
                    final = "failed"
                    break
                now += delay if k + 1 < len(STEPS) else 0
            status, ends, todo = "running", now, [(final,)]
    return sorted((e for e in out if until is None or e[1] <= until), key=str)


def log(seed, n=120, keys=6):
    rng = random.Random(seed)
    return [(f"k{rng.randint(0, keys - 1)}", rng.randint(0, 4000), i) for i in range(n)]


@pytest.mark.parametrize("seed, attempts, cooldown", [(1, 1, 0), (2, 3, 70), (3, 2, 500)])
def test_replay_against_a_loop(spark, seed, attempts, cooldown):
    rows = log(seed)
    machine = jobs.Machine(steps(), delay=100, attempts=attempts, cooldown=cooldown)
    got = sorted(map(tuple, jobs.replayed(spark.createDataFrame(rows, SCHEMA), machine).collect()), key=str)
    assert got == plain(rows, 100, attempts, cooldown)
    assert {"failed", "completed", "started", "already_exists"} <= {e[4] for e in got}
    states = {r.key: r for r in jobs.last_states(spark.createDataFrame(got, jobs.EVENTS), STEPS).collect()}
    for key, r in states.items():
        own = sorted((e for e in got if e[0] == key and e[2] is None), key=lambda e: e[1])
        assert r.status == ("failed" if own[-1][4] == "failed" else "completed") and r.step == own[-1][3] and r.error == (own[-1][5] if r.status == "failed" else "")
        assert r.starts + r.refused == sum(k == key for k, _, _ in rows)


def test_replay_of_nulls_and_nothing(spark):
    machine = jobs.Machine(steps())
    assert jobs.replayed(spark.createDataFrame([], SCHEMA), machine).count() == 0
    rows = [(None, 1, 1), ("a", None, 2), ("a", 1, 4), ("a", 1, 3)]
    asked = [r for r in jobs.replayed(spark.createDataFrame(rows, SCHEMA), machine).collect() if r.id is not None]
    assert [(r.id, r.state) for r in asked] == [(3, "started"), (4, "already_processing")] or [r.id for r in asked] == [3, 4]


def test_stream_against_the_loop_over_restarts(spark, tmp_path):
    """Four runs from one checkpoint: steps go by timers between them, and each key has its own state and error."""
    rows = sorted(log(5, 60, 4), key=lambda r: r[1])
    landing, got = tmp_path / "in", []
    landing.mkdir()
    machine = jobs.Machine(steps(), delay=100, attempts=2, cooldown=50)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    try:
        parts = [rows[:20], rows[20:45], rows[45:], [("end", 90_000, 10_000)], [("end", 91_000, 10_001)]]
        for n, part in enumerate(parts):
            (landing / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "id"), r, strict=True))) for r in part))
            asked = jobs.stream(spark.readStream.schema(SCHEMA).json(str(landing)), machine, late="0 seconds")
            sink = lambda batch, _: got.extend(map(tuple, batch.collect()))
            asked.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((e for e in got if e[0] != "end"), key=str) == plain(rows, 100, 2, 50)
