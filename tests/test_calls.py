"""Calls with outcomes, the ledger of attempts, staged geocoding that asks once, names found in blocks."""

import pytest
from pyspark.sql import functions as F

from scribeflow import ext
from scribeflow.operators import calls, entities
from scribeflow.operators.keyed import KeyedTable, bucket_of


def open_calls():
    """A call that tells how many calls are open in its worker, itself among them."""

    def busy(key):
        import sys
        import threading
        import time

        own = sys.__dict__.setdefault("_open_calls", {"n": 0, "lock": threading.Lock()})
        with own["lock"]:
            own["n"] += 1
            seen = own["n"]
        time.sleep(0.01)
        with own["lock"]:
            own["n"] -= 1
        if key % 10 == 3:
            raise RuntimeError(f"row {key}")
        return seen

    return busy


@pytest.mark.parametrize("at_once", [1, 5])
def test_never_more_calls_than_allowed(spark, at_once):
    rows = spark.range(120).select(F.col("id").alias("key"), F.lit("x").alias("other")).coalesce(1)
    got = calls.settled(rows, open_calls(), ["key"], "int", at_once).collect()
    assert [r.key for r in got] == list(range(120)) and {r.other for r in got} == {"x"}
    assert max(r.value or 0 for r in got) <= at_once and (at_once == 1 or max(r.value or 0 for r in got) > 1)
    assert all((r.error == f"row {r.key}" and r.value is None) if r.key % 10 == 3 else r.error is None for r in got)


def test_values_of_another_type_and_no_rows(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "key long")
    got = {r.key: (r.value, r.error is None) for r in calls.settled(rows, lambda k: {1: "one", 2: [2]}.get(k), ["key"], "string", tasks=2).collect()}
    assert got == {1: ("one", True), 2: (None, False), None: (None, True)}
    assert calls.settled(rows.limit(0), open_calls(), ["key"], "int").count() == 0


def test_verifier_keeps_or_leaves_out_what_failed(spark):
    def yes(name):
        if name == "b":
            raise TimeoutError("late")
        return name == "a"

    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "name string, context string")
    check = ext.verifier(yes, ["name"])
    assert {(r.name, r.confidence) for r in entities.verified(rows, check, ["name"], on_error="keep").collect()} == {("a", "llm_verified"), ("b", "unverified")}
    assert {r.name for r in entities.verified(rows, check, ["name"]).collect()} == {"a"}


def service():
    def tried(key, attempts, partial):
        if key == "never" or (key == "second" and attempts == 0):
            raise ValueError(f"{key} {attempts}")
        return f"{partial or ''}+{attempts}"

    return tried


def state(ledger):
    return {r.key: (r.state, r.attempts, r.error, r.partial) for r in ledger.rows().collect()}


def test_three_attempts_and_cool_down(spark, tmp_path):
    keys = spark.createDataFrame([("ok",), ("second",), ("never",), (None,), ("ok",)], "key string")
    ledger = calls.Ledger.create(keys, f"file://{tmp_path}/l", 4, attempts=3, cooldown=60)
    now = [100.0]
    assert ledger.run(service(), clock=lambda: now[0]) == 3
    assert state(ledger) == {"ok": ("completed", 1, None, "+0"), "second": ("retry", 1, "second 0", None), "never": ("retry", 1, "never 0", None)}
    assert ledger.run(service(), clock=lambda: now[0]) == 0  # they cool down
    now[0] = 160
    assert ledger.run(service(), clock=lambda: now[0]) == 2
    now[0] = 1000
    assert ledger.run(service(), clock=lambda: now[0]) == 1
    assert state(ledger) == {"ok": ("completed", 1, None, "+0"), "second": ("completed", 2, None, "+1"), "never": ("failed", 3, "never 2", None)}
    ledger.add(spark.createDataFrame([("ok",), ("new",)], "key string"))
    assert ledger.run(service(), clock=lambda: now[0]) == 1


def test_a_killed_run_goes_on(spark, tmp_path):
    """What was claimed and never reported comes back after its lease, as a failed attempt; finished keys don't."""
    ledger = calls.Ledger.create(spark.createDataFrame([(f"k{i}",) for i in range(6)], "key string"), f"file://{tmp_path}/l", 4, attempts=2, lease=50)
    lost = {r.key for r in ledger.claim(0, 2).collect()}
    assert len(lost) == 2 and {r.key for r in ledger.claim(0, 6).collect()}.isdisjoint(lost)
    again = calls.Ledger(KeyedTable(spark, f"file://{tmp_path}/l"), attempts=2, lease=50)
    assert again.claim(49, 9).isEmpty()
    got = again.claim(50, 9)
    assert {(r.key, r.attempts) for r in got.collect()} == {(f"k{i}", 1) for i in range(6)}
    again.report(got.where("key <> 'k0'").select("key", F.lit(None).cast("string").alias("error"), F.lit("p").alias("partial")), 60)
    assert again.claim(100, 9).isEmpty()  # k0 was lost twice and is given up
    assert state(again)["k0"][:3] == ("failed", 2, "lost") and {s[0] for k, s in state(again).items() if k != "k0"} == {"completed"}


def test_time_limit(spark, tmp_path):
    ledger = calls.Ledger.create(spark.createDataFrame([(f"k{i}",) for i in range(9)], "key string"), f"file://{tmp_path}/l", 2)
    ticks = iter(range(0, 1000, 10))
    assert ledger.run(lambda k, a, p: "", batch=2, limit=25, clock=lambda: next(ticks)) == 2


def test_geocoding_asks_only_what_is_open_and_once(spark, tmp_path):
    names = spark.createDataFrame([("Found",), ("A & B",), ("C & D",), ("Nowhere",), ("Found",), (None,), ("Far",)], "name string")
    known = spark.createDataFrame([("Found San Francisco CA", 37.75, -122.4), ("A and B, San Francisco", 37.76, -122.4), ("C, San Francisco CA", 37.77, -122.4), ("Far San Francisco CA", 10.0, 10.0)], "query string, lat double, lng double")
    asked = []

    def lookup(rows):
        asked.append(sorted((r.step, r.query, r.bounded) for r in rows.collect()))
        return rows.join(known, "query").where("query NOT LIKE 'Far%' OR NOT bounded").select("name", "step", "lat", "lng")

    want = {("Found", 37.75), ("A & B", 37.76), ("C & D", 37.77), ("Nowhere", None), (None, None), ("Far", None)}
    plain = entities.geocode_cascade(names, lookup)
    assert {(r.name, r.lat) for r in plain.collect()} == want and plain.count() == 7
    assert [len(a) for a in asked] == [5, 2, 1, 2]  # one call for a name that the first step finds
    cache = KeyedTable.create(spark.createDataFrame([], "query string, bounded boolean, lat double, lng double"), f"file://{tmp_path}/c", ["query", "bounded"], 4)
    for n in range(2):
        asked.clear()
        assert {(r.name, r.lat) for r in entities.geocode_cascade(names, lookup, cache=cache).collect()} == want
        assert sum(map(len, asked)) == (10 if n == 0 else 0)  # the second time the cache knows all, also what isn't found


def test_names_in_blocks_equal_one_block(spark):
    words = ["red", "blue", "door", "the", "o'neil", "a"]
    names = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words] + [(None,), ("",), ("red",)], "name string")
    segments = spark.createDataFrame([("e", i, f"{words[i % 6]} {words[i % 5]} {words[i % 4].upper()} {words[i % 3]}") for i in range(60)] + [("e", 99, None)], "episode_id string, seq long, text string")
    rows = lambda block: sorted((r.name, r.seq) for r in entities.mentions(names, segments, block=block).collect())
    assert rows(200_000) == rows(3) and len(rows(3)) > 50
    phrases = lambda block: sorted((r.normalized_name, r.seq) for r in entities.phrase_mentions(names.withColumnRenamed("name", "normalized_name"), segments, block=block).collect())
    assert phrases(200_000) == phrases(4) and phrases(4)
    assert entities.mentions(names.limit(0), segments).count() == 0


def test_large_claims_change_few_buckets_and_spread_their_calls(spark, tmp_path, monkeypatch):
    """Keys of a large claim are those that wait longest, exactly so many, of few buckets, and dealt to several tasks."""
    monkeypatch.setattr(calls, "LARGE", 100)
    monkeypatch.setattr(calls, "EACH", 50)
    monkeypatch.setattr(calls, "BUCKET", 200)
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("at"))
    ledger = calls.Ledger.create(keys, f"file://{tmp_path}/l", 2, attempts=2)
    assert ledger.table.buckets == 15
    files = lambda: ledger.table.log.read()[1]["files"]
    seen = set()
    for waits, most in ((0, 300), (0, 700), (1, 1000), (2, 999), (2, 1000)):
        before = files()
        claimed = ledger.claim(5, most)
        got = {r.key for r in claimed.collect()}
        assert len(got) == (1 if len(seen) == 2999 else most) and {int(k) % 3 for k in got} == {waits} and seen.isdisjoint(got)
        if most == 300:
            assert sum(files()[b] != name for b, name in before.items()) <= 6 and claimed.rdd.getNumPartitions() >= 2
        seen |= got
    assert len(seen) == 3000 and ledger.claim(5, 1000).isEmpty()


def small_sizes(monkeypatch, spans=8):
    for name, n in (("LARGE", 20), ("EACH", 50), ("BUCKET", 100), ("SPANS", spans)):
        monkeypatch.setattr(calls, name, n)


def truth(ledger):
    """What the rows say of each bucket: the first end of a lease, the most attempts of those that wait, and the times they wait for."""
    out = {}
    for r in ledger.rows().withColumn("_b", bucket_of(["key"], ledger.table.buckets)).collect():
        lease, tries, times = out.setdefault(str(r._b), ([], [], []))
        if r.state == "running":
            lease.append(r.lease)
        elif r.state in ("pending", "retry"):
            tries.append(r.attempts)
            times.append(r.not_before)
    return {b: (min(x, default=None), max(y, default=None), sorted(z)) for b, (x, y, z) in out.items()}


def test_a_large_run_reads_each_bucket_a_few_times(spark, tmp_path, monkeypatch):
    """What a claim and its report read grows with the claim, not with the ledger: all buckets are read for the waits between attempts alone."""
    small_sizes(monkeypatch)
    read, real = [], KeyedTable.rows_of
    monkeypatch.setattr(KeyedTable, "rows_of", lambda self, files: read.append(len(files)) or real(self, files))
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    ledger, now = calls.Ledger.create(keys, f"file://{tmp_path}/l", 2, attempts=2, cooldown=60), [5.0]

    def half(key, attempts, partial):
        if int(key) % 2 and attempts == 0:
            raise ValueError("first")
        return f"{attempts}"

    assert ledger.table.buckets == 20
    assert ledger.run(half, batch=250, clock=lambda: now[0], wait=lambda s: now.__setitem__(0, now[0] + s)) == 3000
    assert state(ledger) == {str(k): ("completed", 1 + k % 2, None, str(k % 2)) for k in range(2000)}
    assert sum(read) <= 20 * 8 and max(read[:12]) <= 5  # 8 claims of 3 or 4 buckets, then 4 of 5 or 6; all for the wait between, and at the end


@pytest.mark.parametrize("spans", [8, 1])
def test_claims_by_what_the_list_tells_equal_claims_of_all_rows(spark, tmp_path, monkeypatch, spans):
    """Large and small claims, lost runs, keys given up, keys added, and buckets of which the list tells nothing."""
    import random

    small_sizes(monkeypatch, spans)
    rng, folder = random.Random(spans), f"file://{tmp_path}/l"
    keys = spark.range(400).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("at"))
    ledger = calls.Ledger.create(keys, folder, 4, attempts=2, cooldown=7, lease=10)
    model = {str(k): ["pending", 0, k % 3, None] for k in range(400)}
    held, now = [], 1
    for step, most in enumerate((70, 30, 5, 90, 500, 60, 25, 500, 500)):
        for k, (what, tries, at, lease) in model.items():  # as of now
            if what == "running" and lease <= now:
                model[k] = ["lost", tries + 1, at, lease]
        ready = {k: m for k, m in model.items() if m[0] == "lost" or m[0] in ("pending", "retry") and m[2] <= now}
        can = {k: m for k, m in ready.items() if m[1] < 2}
        got = {r.key: r.attempts for r in ledger.claim(now, most).collect()}
        assert got.keys() <= can.keys() and all(can[k][1] == n for k, n in got.items())
        assert sorted(can[k][2] for k in got) == sorted(m[2] for m in can.values())[:most]
        for k in ready.keys() - can.keys():
            model[k] = ["failed", model[k][1], model[k][2], None]
        for k in got:
            model[k] = ["running", model[k][1], model[k][2], now + 10]
        for k, m in model.items():
            if m[0] == "lost":  # not taken: as it was
                m[:2] = "running", m[1] - 1
        held += got
        told, held = (held[: len(held) // 2], held[len(held) // 2 :]) if step % 2 else ([], held)
        told = sorted({k for k in told if model[k][0] == "running"})
        if told:
            bad = {k: rng.random() < 0.5 for k in told}
            ledger.report(spark.createDataFrame([(k, "no" if bad[k] else None, None) for k in told], "key string, error string, partial string"), now)
            for k in told:
                n = model[k][1] + 1
                model[k] = ["completed" if not bad[k] else "failed" if n >= 2 else "retry", n, now + 7, None]
        if step == 3:
            KeyedTable(spark, folder).patch(spark.createDataFrame([(str(k), "p") for k in range(3)], "key string, partial string"))
            assert len(ledger.table.log.read()[1]["notes"]) < 4
            ledger.add(spark.createDataFrame([(f"new{k}", k) for k in range(50)], "key string, at long"))
            model |= {f"new{k}": ["pending", 0, k, None] for k in range(50)}
        assert {r.key: [r.state, r.attempts, r.not_before, r.lease] for r in ledger.rows().collect()} == model
        want, told_of = truth(ledger), ledger.table.log.read()[1]["notes"]
        for b, (lease, tries, known) in told_of.items():
            first, most_tries, times = want[b]
            assert (lease if lease is not None else 1e9) <= (first if first is not None else 1e9) and (tries or 0) >= (most_tries or 0)
            assert sum(n for *_, n in known) == len(times) and len(known) <= spans
            assert all(sum(lo <= t <= hi for t in times) == n for lo, hi, n in known)
        now += 4


def test_keys_that_come_while_a_large_claim_runs_stay(spark, tmp_path, monkeypatch):
    """A report of a claim whose buckets someone changed meanwhile changes its own keys alone."""
    small_sizes(monkeypatch)
    ledger = calls.Ledger.create(spark.range(120).select(F.col("id").cast("string").alias("key")), f"file://{tmp_path}/l", 3, attempts=2, cooldown=60)
    asked, now = [], [5.0]

    def clock():  # of a run: its beginning, the first claim, the first report
        asked.append(1)
        if len(asked) == 4:
            calls.Ledger(KeyedTable(spark, f"file://{tmp_path}/l")).add(spark.createDataFrame([(f"new{k}",) for k in range(30)], "key string"))
        return now[0]

    assert ledger.run(lambda key, attempts, partial: f"done {key}", batch=100, limit=1000, clock=clock) == 150
    names = [*map(str, range(120)), *(f"new{k}" for k in range(30))]
    assert len(asked) >= 4 and state(ledger) == {k: ("completed", 1, None, f"done {k}") for k in names}


def test_hits_are_handed_on_without_texts(spark, monkeypatch):
    """A text with very many names isn't copied for each of them."""
    from scribeflow.operators import trie

    frames, real = [], trie.found
    monkeypatch.setattr(trie, "found", lambda *a, **k: frames.append(real(*a, **k)) or frames[-1])
    words = [f"word{i}" for i in range(5000)]
    turns = spark.createDataFrame([(1, i, i * 10, i * 10 + 8, " ".join(words)) for i in range(6)], "episode_id long, seq long, start_ms long, end_ms long, text string")
    names = spark.createDataFrame([(w, 1, 2, "a") for w in words], "normalized_name string, start_ms long, end_ms long, address string")
    got = entities.cross_reference(names, turns, ())
    assert {(r.normalized_name, r.episode_count, r.total_mentions) for r in got.collect()} == {(w, 1, 1) for w in words}
    assert frames[0].columns == ["episode_id", "_name"]


def test_names_that_no_text_can_hold_cost_no_pass(spark, monkeypatch):
    """Of names of several blocks, those with a word that stands in no text are left out before the texts are passed over."""
    from scribeflow.operators import trie

    kept, real = [], trie._possible
    monkeypatch.setattr(trie, "_possible", lambda *a: kept.append(real(*a)) or kept[-1])
    monkeypatch.setattr(entities._named, "__defaults__", (10,))
    names = spark.createDataFrame([(f"person {i}",) for i in range(50)] + [("red door",), ("red",), ("red",), ("Person 7",)], "name string")
    segments = spark.createDataFrame([("b", 1, "no"), ("b", 2, "a RED door"), ("b", 3, "red door, red"), ("c", 1, "person 7 red")], "episode_id string, seq long, text string")
    got = {tuple(r) for r in entities.mention_counts(names, segments).collect()}
    assert got == {("red door", 1, 2), ("red", 2, 6), ("person 7", 1, 1), ("Person 7", 1, 1)}
    assert {r._name for r in kept[0].collect()} == {"red door", "red", "person 7", "Person 7"}
    places = spark.createDataFrame([(1, "red"), (2, "person 7"), (3, "person 8")], "id long, name string")
    assert {tuple(r) for r in entities.place_samples(places, segments).collect()} == {(1, "red", "a RED door"), (2, "person 7", "person 7 red"), (3, "person 8", None)}
