"""Streams and sources: rate limits, ingest, dedupe, transcripts, listings, scraping, the paged registry, progress."""

import json
import random

from pyspark.sql import functions as F

from scribeflow import ext
from scribeflow.operators import catalog, clean, entities, lexicon, tables
from scribeflow.sources import candidates, listings, paged, pages, speech, transcripts
from scribeflow.streaming import ingest, ratelimit


def plain_gate(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 3)}", rng.randint(0, 200), i) for i in range(400)]
    got = ratelimit.admitted(spark.createDataFrame(rows, "key string, at long, event_id long"), 5, 60).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r.at, r.event_id, r.admitted) for r in got if r.key == k)
        assert [x[2] for x in own] == plain_gate([x[0] for x in own], 5, 60)
    assert len(got) == 400


def test_rate_limit_of_nulls_and_nothing(spark):
    ddl = "key string, at long, event_id long"
    assert ratelimit.admitted(spark.createDataFrame([], ddl), 1, 1).count() == 0
    assert ratelimit.admitted(spark.createDataFrame([(None, 1, 1), ("a", None, 2), ("a", 1, 3)], ddl), 1, 1).count() == 1


def transcript(i, texts):
    return {"episode_id": i, "title": f"t {i}", "segments": [{"start_ms": k * 40_000, "end_ms": k * 40_000 + 30_000, "text": t} for k, t in enumerate(texts)]}


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(transcript("ep-a", ["one", "two"]), indent=1))
    (tmp_path / "b.json").write_text('{"title": "no id", "segments": null}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("{}")
    got = {r.episode_id: r for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert set(got) == {"ep-a", "b"} and got["b"].segments == []
    seg = transcripts.segments_of(transcripts.read_transcripts(spark, str(tmp_path)))
    assert [(r.seq, r.text) for r in seg.orderBy("seq").collect()] == [(1, "one"), (2, "two")]
    assert transcripts.write_transcripts(seg, spark.createDataFrame([("ep-a", "t")], "id string, title string"), str(tmp_path / "out")) == 1
    assert json.loads((tmp_path / "out" / "ep-a.json").read_text())["segments"][1]["text"] == "two"
    assert transcripts.read_transcripts(spark, str(tmp_path)).count() == 2
    assert [tuple(r) for r in transcripts.broken_transcripts(spark, str(tmp_path)).collect()] == [("c", None, "{broken")]


def test_transcripts_round_trip(spark, tmp_path):
    """All episodes of one partition come back, whatever their ids are; one document a file."""
    ids = [f"ep {i}" for i in range(37)] + ["a/b", "é.json", "100%"]
    rows = [(i, k + 1, k * 1000, k * 1000 + 900, f"line {k}\nof {i}") for i in ids for k in range(3)]
    segments = spark.createDataFrame(rows, "episode_id string, seq long, start_ms long, end_ms long, text string").coalesce(1)
    episodes = spark.createDataFrame([(i, f"title {i}") for i in ids[:-1]], "id string, title string")
    for _ in range(2):  # a second run writes the same files
        assert transcripts.write_transcripts(segments, episodes, str(tmp_path / "out")) == 40
    back = transcripts.read_transcripts(spark, str(tmp_path / "out"))
    assert back.count() == 40 and len(list((tmp_path / "out").glob("*.json"))) == 40
    assert sorted((r.episode_id, r.title) for r in back.select("episode_id", "title").collect()) == sorted((i, f"title {i}" if i != ids[-1] else i) for i in ids)
    assert sorted(map(tuple, transcripts.segments_of(back).collect())) == sorted(rows)


def test_files_of_json_lines(spark, tmp_path):
    """Each line is a document; a broken one costs itself alone; a missing id is the stem and the line."""
    lines = [json.dumps(transcript("a", ["one"])), "", json.dumps({"title": "no id"}), "{broken", json.dumps(transcript("b", ["two", "three"]))]
    (tmp_path / "many.json").write_text("\r\n".join(lines) + "\n")
    (tmp_path / "empty.json").write_text("")  # Spark reads no row of it
    (tmp_path / "list.json").write_text("[1, 2]")
    got = {r.episode_id: len(r.segments) for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "many-2": 0, "b": 2}
    broken = {(r.stem, r.line): r.content for r in transcripts.broken_transcripts(spark, str(tmp_path)).collect()}
    assert broken.pop(("many", 3)) == "{broken" and set(broken) == {("list", None)}


def test_ingest_is_idempotent(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    text = ["this is the first segment of it", "this is the second segment"]
    (landing / "a.json").write_text(json.dumps(transcript("a", text)))
    ingest.start(spark, str(landing), str(out), str(tmp_path / "ck")).awaitTermination()
    (landing / "a-again.json").write_text(json.dumps(transcript("a", text)))
    (landing / "b.json").write_text(json.dumps(transcript("b", text)))
    ingest.start(spark, str(landing), str(out), str(tmp_path / "ck")).awaitTermination()
    seg = spark.read.parquet(str(out / "segments"))
    assert sorted((r.episode_id, r.seq) for r in seg.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    states = ingest.with_failures(spark.read.parquet(str(out / "status"))).collect()
    assert states and all(r.state == "completed" for r in states)
    assert sorted((r.episode_id, r.seq) for r in ingest.index(spark, str(out)).match("segment").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    again = spark.createDataFrame([("b", "t b", [(0, 30_000, text[0]), (40_000, 70_000, text[1])])], "episode_id string, title string, segments array<struct<start_ms: long, end_ms: long, text: string>>")
    ingest.write_batch(str(out))(again, 1)  # the batch runs again: nothing is there twice
    assert spark.read.parquet(str(out / "segments")).count() == 4 and ingest.index(spark, str(out)).match("segment").count() == 4


def test_ingest_of_files_without_ids_and_broken_ones(spark, tmp_path):
    """Stems are ids, broken files are left out, and a document that comes again goes no further."""
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for name in ("x", "y"):
        (landing / f"{name}.json").write_text(json.dumps({"segments": [{"start_ms": 0, "end_ms": 30_000, "text": f"segment of {name} at the Blue Door"}]}))
    (landing / "z.json").write_text("{broken")
    services = ingest.Services(find_places=ext.named_places(("Blue Door", "Red Door")), audio=ext.audio_addresses("http://a"), summarise=lambda asked: asked.select("id", F.lit('{"title": "T", "summary": "S"}').alias("reply")))
    ingest.start(spark, str(landing), str(out), str(tmp_path / "ck"), services).awaitTermination()
    (landing / "again.json").write_text(json.dumps(transcript("x", ["other text that comes too late"])))
    ingest.start(spark, str(landing), str(out), str(tmp_path / "ck"), services).awaitTermination()
    read = lambda t: spark.read.parquet(str(out / t))
    assert sorted(r.episode_id for r in read("segments").collect()) == ["x", "y"]
    assert sorted((r.episode_id, r.state) for r in read("documents").collect()) == [("x", "already_exists"), ("x", "completed"), ("y", "completed")]
    assert [(r.name, r.episodes) for r in read("places").collect()] == [("Blue Door", ["x", "y"])]
    assert sorted(r.audio_file for r in read("audio").collect()) == ["http://a/x.m4a", "http://a/y.m4a"]
    assert {(r.id, r.title, r.summary) for r in read("summaries").collect()} == {("x", "T", "S"), ("y", "T", "S")}
    index = ingest.index(spark, str(out))
    assert {r.episode_id for r in index.bm25('"blue door"').collect()} == {"x", "y"} and index.match("late").count() == 0


def test_a_failed_stage(spark, tmp_path):
    """A soft stage that fails is recorded and passed over; another one ends the batch, which then runs again."""
    def broken(asked):
        raise ValueError("no service")

    docs = spark.createDataFrame([("a", "t", [(0, 30_000, "a segment of some length here")])], "episode_id string, title string, segments array<struct<start_ms: long, end_ms: long, text: string>>")
    out = str(tmp_path / "out")
    ingest.write_batch(out, ingest.Services(find_places=broken))(docs, 0)
    states = {r.stage: (r.state, r.error) for r in spark.read.parquet(f"{out}/status").collect()}
    assert states["places"] == ("failed", "no service") and states["segments"] == ("completed", "")
    episode = lambda rows: {(r.episode_id, r.state, r.error) for r in rows.select("episode_id", "state", "error").collect()}
    ingest.write_batch(out, ingest.Services(summarise=broken))(docs.withColumn("episode_id", F.lit("b")), 1)
    assert episode(spark.read.parquet(f"{out}/documents").where("batch = 1")) == {("b", "failed", "no service")}
    assert ingest.index(spark, out).match("segment").select("episode_id").distinct().count() == 1
    ingest.write_batch(out)(docs.withColumn("episode_id", F.lit("b")), 2)  # it comes again
    assert episode(ingest.admitted(spark, out).rows()) == {("a", "completed", None), ("b", "completed", None)}


def test_episodes_that_fail_cost_no_other(spark, tmp_path):
    """Two of nine episodes make a stage fail: they end as failed with their own error, the others go through."""
    kind = "episode_id string, title string, segments array<struct<start_ms: long, end_ms: long, text: string>>"
    docs = spark.createDataFrame([(f"e{i}", "t", [(0, 30_000, f"segment {i} of some length here")]) for i in range(9)], kind)

    def summarise(asked):
        bad = F.col("id").isin("e3", "e7")
        return asked.select("id", F.when(bad, F.raise_error(F.concat(F.lit("bad "), "id")).cast("string")).otherwise('{"title": "T", "summary": "S"}').alias("reply"))

    out = str(tmp_path / "out")
    ingest.write_batch(out, ingest.Services(summarise=summarise))(docs, 0)
    states = {r.episode_id: (r.state, r.error) for r in ingest.admitted(spark, out).rows().collect()}
    assert {k for k, v in states.items() if v[0] == "failed"} == {"e3", "e7"} and all(f"bad {k}" in states[k][1] for k in ("e3", "e7"))
    assert sorted(r.id for r in spark.read.parquet(f"{out}/summaries").collect()) == [f"e{i}" for i in range(9) if i not in (3, 7)]
    assert sorted(r.episode_id for r in ingest.index(spark, out).match("segment").collect()) == [f"e{i}" for i in range(9) if i not in (3, 7)]
    assert ingest.failing(docs, lambda part: 1 / 0, "all", trials=0).count() == 9


def test_admitted_stream_against_a_loop(spark, tmp_path):
    """Three runs of the stream over files in order of time: decisions as of one loop; what comes far too late is dropped."""
    rng = random.Random(5)
    rows = sorted((rng.randint(1000, 1900), f"k{rng.randint(0, 2)}", i) for i in range(300))
    landing = tmp_path / "in"
    landing.mkdir()
    ddl = "key string, at long, event_id long"
    got = []
    sink = lambda batch, _: got.extend(map(tuple, batch.collect()))
    for part in range(3):
        own = rows[part * 100 : part * 100 + 100] + ([(0, "k0", 999)] if part == 2 else [])
        (landing / f"{part}.json").write_text("\n".join(json.dumps({"key": k, "at": t, "event_id": i}) for t, k, i in own))
        stream = ratelimit.admitted_stream(spark.readStream.schema(ddl).json(str(landing)), 5, 60, late_s=30)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[2] for r in got) == list(range(300))
    for k in {r[0] for r in got}:
        own = sorted((r[1], r[2], r[3]) for r in got if r[0] == k)
        assert [x[2] for x in own] == plain_gate([x[0] for x in own], 5, 60)


def test_upload_events(spark, tmp_path):
    lines = [{"object": {"key": "x/one.MP3", "size": 3}}, {"object": {"key": "x/two.wav", "size": 3}}, {"object": {}}, {"object": {"key": "x/one.MP3", "size": 3}}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    stream = ingest.once_per_key(ingest.upload_events(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("uploads").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.key for r in spark.table("uploads").collect()] == ["x/one.MP3"]


def test_listing(spark, tmp_path):
    for n, size in (("a b.mp3", 5), ("skip.mp3", 1), ("c.txt", 2)):
        (tmp_path / n).write_bytes(b"x" * size)
    assert [(r.filename, r.size) for r in listings.audio_files(spark, str(tmp_path), ("skip.mp3",)).collect()] == [("a b.mp3", 5)]


def test_broadcast_pages(spark):
    one = '<a href="/broadcasts/12">x</a> <time datetime="2024-05-02T07:30">' + '<a href="/broadcasts/13">y</a> <time datetime="2024-05-09T07:30">'
    other = '<time datetime="2024-05-16T07:30"> <a href="/broadcasts/14">'
    got = pages.broadcasts(spark.createDataFrame([(1, one), (2, other), (3, "none")], "page_id long, html string")).collect()
    assert {(r.id, r.date) for r in got} == {("12", "2024-05-02"), ("13", "2024-05-09"), ("14", "2024-05-16")}


def canned(category, offset, limit, where):
    rows = [{"id": i, "kind": category, "city": "here" if i % 2 else "there"} for i in range(7)]
    rows = [r for r in rows if all(r[k] == v for k, v in where.items())]
    return rows[offset : offset + limit]


def test_paged_registry(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    reader = paged.PagedReader({"fetch": f"{__name__}.canned", "categories": "a,b", "page_size": "2", "most": "5"}, ["id", "kind", "city"])
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [5, 5]
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("city",), "here"), GreaterThan(("id",), 1)]))
    assert len(left) == 1 and [r[0] for r in reader.read(reader.partitions()[0])] == [1, 3, 5]


def moody(category, offset, limit, where, order):
    """Busy twice, then rows in the order asked for; the quota ends at 6."""
    MOOD.append(order)
    if len(MOOD) < 3:
        raise paged.Busy
    if offset >= 6:
        raise paged.QuotaReached
    return [{"id": i} for i in sorted(range(20), reverse=order == "id DESC")][offset : offset + limit]


MOOD = []


def test_registry_that_is_busy_and_ends():
    MOOD.clear()
    options = {"fetch": f"{__name__}.moody", "categories": "a", "page_size": "2", "order": "id DESC", "pauses": "0,0"}
    reader = paged.PagedReader(options, ["id"])
    assert [r[0] for r in reader.read(reader.partitions()[0])] == [19, 18, 17, 16, 15, 14] and set(MOOD) == {"id DESC"}
    parts = paged.PagedReader(options | {"most": "9", "pages": "2"}, ["id"]).partitions()
    assert [(p.first, p.end) for p in parts] == [(0, 4), (4, 8), (8, 9)]


def test_candidates_of_registries_and_reviews(spark):
    rows = spark.createDataFrame([(1, " Blue Door ", "1 Main", "Town", None, "2020", None, "9"), (2, "BLUE DOOR", "2 Main", None, None, None, None, None), (3, " ", "x", None, None, None, None, None)], "ord long, name string, street string, city string, state string, start_date string, end_date string, row_id string")
    assert [(r.name, r.address, r.meta) for r in candidates.registry(rows).collect()] == [("Blue Door", "1 Main, Town", {"start_date": "2020", "row_id": "9"})]
    rows = spark.createDataFrame([(1, "b1", "X", ["1 Main", "Town"], 1.0, 2.0, "bar"), (2, "b1", "Y", [], 1.0, 2.0, "cafe"), (3, None, "Z", [], None, None, "bar")], "ord long, business_id string, name string, address_lines array<string>, lat double, lng double, category string")
    assert [(r.name, r.address, r.category, r.meta) for r in candidates.reviews(rows).collect()] == [("X", "1 Main, Town", "bar", {"business_id": "b1"})]


def test_today(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from scribeflow.plans import api

    eps = spark.sql("SELECT id, 't' AS title, date_add(current_date(), int(id) - 3) AS published_at FROM range(7) AS t(id)")
    zone = ZoneInfo("America/Los_Angeles")
    before = datetime.now(zone).strftime("%m-%d")
    got = {r.published_at.strftime("%m-%d") for r in api.on_this_day(eps).collect()}
    assert got <= {before, datetime.now(zone).strftime("%m-%d")} and len(got) == 1


def test_speech_rounding(spark):
    reply = json.dumps({"segments": [{"start": 0.0005, "end": 1.2345, "text": " a "}, {"start": 2, "end": 3, "text": "  "}]})
    got = speech.from_seconds(spark.createDataFrame([("e", reply)], "episode_id string, reply string"), 100).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(101, 1335, "a")]


def test_progress(spark):
    rows = spark.createDataFrame([("a", "completed", None), ("b", "failed", "x"), ("c", "skipped", "Hallucination: y"), ("d", "skipped", "short")], "recording_id string, status string, reason string")
    assert {r.recording_id for r in catalog.pruned_progress(rows, "hallucination").collect()} == {"a", "d"}
    assert catalog.time_left(spark.createDataFrame([], "seconds double"), 2).first().minutes == 130.0
    counts = catalog.status_counts(rows).first()
    assert (counts.total, counts.completed, counts.pending, counts.failed, counts.skipped, counts.percent) == (4, 1, 0, 1, 2, 25.0)


def test_writes(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id long, name string")
    assert sorted(map(tuple, tables.insert_ignore(stored, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    patched = tables.patch(stored, spark.createDataFrame([(1, ""), (2, "z")], "id long, name string"), "id", ("name",))
    assert sorted(map(tuple, patched.collect())) == [(1, "a"), (2, "z")]
    assert tables.replace_by_key(stored, new.where("id = 3"), "id", stored.where("id = 1")).count() == 3


def test_verification_policies(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, context string")
    verdicts = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, verdict boolean")
    names = lambda df: {r.name: r.confidence for r in df.collect()}
    check = lambda asked: verdicts
    assert names(entities.verified(records, check, ["name"])) == {"a": "llm_verified"}
    assert names(entities.verified(records, check, ["name"], "keep")) == {"a": "llm_verified", "c": "unverified"}
    assert set(names(entities.verified(records, None, ["name"])).values()) == {"unverified"}
    assert names(entities.verified(records, ext.all_verified, ["name"])).keys() == {"a", "b", "c"}


def test_summaries(spark):
    ddl = "episode_id string, seq long, start_ms long, end_ms long, text string"
    seg = spark.createDataFrame([("e", 2, 0, 0, "two"), ("e", 1, 0, 0, "one")], ddl)
    eps = spark.createDataFrame([("e", "old", None, None)], "id string, title string, published_at date, summary string")
    assert ext.summary_prompt(seg, eps).first().prompt.endswith("Date: unknown\n\none\ntwo")
    out = ext.applied_summaries(eps.select("id", "title", "summary"), spark.createDataFrame([("e", '{"summary": "new"}')], "id string, reply string")).first()
    assert (out.title, out.summary) == ("old", "new")


def test_guest_starts_to_set(spark):
    found = spark.createDataFrame([("a", 10), ("b", 10), ("c", 99), ("d", 10), ("e", 5)], "episode_id string, guest_start_ms long")
    eps = spark.createDataFrame([("a", 50, None), ("b", 50, 7), ("c", 50, None), ("d", 20, None), ("e", 0, None)], "id string, duration_ms long, guest_start_ms long")
    assert {r.episode_id for r in clean.guest_starts_to_set(found, eps, 30).collect()} == {"a", "e"}
    assert {r.episode_id for r in clean.guest_starts_to_set(found, eps, 30, force=True).collect()} == {"a", "b", "e"}


def test_words(spark):
    seg = spark.createDataFrame([("Rock'n'roll --the-- cat's 'tis café ok",)], "text string")
    assert sorted(r.word for r in lexicon.words(seg).collect()) == ["caf", "cat's", "rock'n'roll", "tis"]
    star = lexicon.constellation(spark.createDataFrame([("coffee coffee bread",)], "text string"), labels=1).collect()
    assert [(r.word, r["count"], r.labelled) for r in star] == [("coffee", 2, True), ("bread", 1, False)]
    from scribeflow.functions import formats as X

    assert spark.range(1).select(X.fnv1a(F.lit("coffee"))).first()[0] == 2385279649
