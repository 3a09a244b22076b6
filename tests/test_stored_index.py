"""The stored index of segments and tombstones: equal to a fresh build after any batches, in proportion, merged by size."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scribeflow.operators import textindex
from scribeflow.operators.indexlog import StoredIndex, merge_from
from scribeflow.operators.snapshots import Conflict, Snapshots

SCHEMA = "episode_id long, seq long, text string"
WORDS = "the cat sat on a mat dog ran to café naïve cat".split()


def rows_of(index, query):
    return sorted((r.episode_id, r.seq, round(r["rank"], 9)) for r in index.bm25(query).collect())


def texts(rng, episode):
    return [(episode, i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(1, 4))]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_equal_a_fresh_build(spark, tmp_path, seed):
    rng, state = random.Random(seed), {}
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    for step in range(9):
        new = {e: texts(rng, e) for e in rng.sample(range(30), rng.randint(0, 6))}
        gone = rng.sample(range(30), rng.randint(0, 3))
        state = {e: r for e, r in state.items() if e not in gone} | new
        segments = spark.createDataFrame([r for rs in new.values() for r in rs], SCHEMA)
        index.write(segments, spark.createDataFrame([(e,) for e in gone], "episode_id long"))
        if step % 3 == 2:
            index.compact(whole=step == 8)
        if step % 2 == 0 or step == 8:
            want = textindex.Index.of(spark.createDataFrame([r for rs in state.values() for r in rs], SCHEMA))
            for query in (["cat"], ["the cat", "sat"]):
                assert rows_of(index.index(), query) == rows_of(want, query)
            assert sorted(map(tuple, index.index().lengths.collect())) == sorted(map(tuple, want.lengths.collect()))
    listed = index.log.read()[1]
    assert len(listed["segments"]) == 1 and not listed["dead"]


def test_merge_leaves_each_larger_than_all_newer():
    for sizes in ([], [5], [1, 1], [100, 10, 5, 5], [8, 4, 2, 1], [1] * 50, [3, 9, 1]):
        at = merge_from(sizes)
        left = sizes[:at] + ([sum(sizes[at:])] if sizes[at:] else [])
        assert all(left[i] > sum(left[i + 1 :]) for i in range(len(left))) and at != len(sizes) - 1


def test_a_batch_writes_its_own_rows_and_merges_keep_few_segments(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    rng, most = random.Random(5), 0
    index.write(spark.createDataFrame([r for e in range(200) for r in texts(rng, e)], SCHEMA))
    for n in range(6):
        before = set(os.listdir(tmp_path / "i" / "data"))
        index.write(spark.createDataFrame(texts(rng, n), SCHEMA))
        new = set(os.listdir(tmp_path / "i" / "data")) - before
        listed = index.log.read()[1]
        assert new == {listed["segments"][-1]["name"], listed["dead"][-1]["name"]} and listed["segments"][-1]["episodes"] == 1
        assert spark.read.parquet(f"{tmp_path}/i/data/{listed['segments'][-1]['name']}/postings").select("episode_id").distinct().count() <= 1
        index.compact()
        most = max(most, len(index.log.read()[1]["segments"]))
    assert most <= 4
    assert index.vacuum() and index.index().lengths.count() == 200
    assert index.vacuum() == []


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    index.write(spark.createDataFrame([(1, 1, "cat one"), (2, 1, "cat two")], SCHEMA))
    index.write(spark.createDataFrame([(1, 1, "dog")], SCHEMA), spark.createDataFrame([(2,)], "episode_id long"))
    assert [r[:2] for r in rows_of(index.index(1), ["cat"])] == [(1, 1), (2, 1)] and rows_of(index.index(), ["cat"]) == []
    index.compact(whole=True)
    assert [r[:2] for r in rows_of(index.index(), ["dog"])] == [(1, 1)]
    assert [r[:2] for r in rows_of(index.index(1), ["cat"])] == [(1, 1), (2, 1)]
    index.vacuum()
    with pytest.raises(ValueError):
        index.index(1)


def test_failed_and_empty_batches_change_nothing(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    good = spark.createDataFrame([(1, 1, "cat"), (None, 1, "cat")], SCHEMA)
    index.write(good)
    with pytest.raises(Exception, match="broken"):
        index.write(good.withColumn("text", F.when(F.raise_error(F.lit("broken")).isNull(), "x")))
    index.write(good.limit(0), good.limit(0))
    assert index.log.versions() == [1] and [r[:2] for r in rows_of(index.index(), ["cat"])] == [(1, 1)]
    assert StoredIndex(spark, f"file://{tmp_path}/none").index().match("cat").count() == 0


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    a, b = Snapshots(spark, f"file://{tmp_path}/s"), Snapshots(spark, f"file://{tmp_path}/s")
    number, _ = a.read()
    assert a.commit(number, {"x": 1}) == 1
    with pytest.raises(Conflict):
        b.commit(number, {"x": 2})
    assert b.read() == (1, {"x": 1}) and a.versions() == [1]


def test_pages_of_newest_episodes_read_no_older_postings(spark, tmp_path, monkeypatch):
    """The page is that of a scan; of a corpus ten times as large, a page of common words reads no more postings."""
    from scribeflow.operators import indexlog
    from scribeflow.plans import api

    monkeypatch.setattr(indexlog, "RANKS", (8, 16, 32))
    read = {}
    for n in (60, 600):
        rows = [(e, i, i * 1000, i * 1000 + 900, f"the cat number {e} sat" if e % 3 else "the dog") for e in range(n) for i in range(3)]
        segments = spark.createDataFrame(rows, "episode_id long, seq long, start_ms long, end_ms long, text string")
        episodes = spark.createDataFrame([(e, f"t{e}", 1, "s") for e in range(n) if e % 10], "id long, title string, duration_ms long, summary string")
        stored = StoredIndex(spark, f"file://{tmp_path}/i{n}")
        stored.write(segments.where("episode_id % 2 = 0"))
        stored.write(segments.where("episode_id % 2 = 1"))
        index = stored.index()
        assert index.newest and len(index.newest.bounds) >= 2
        for query, page in ((["the", "cat"], 1), (["the", "cat"], 3), (["the cat"], 1), (["dog"], 2), (["number", "7"], 1), (["missing"], 1)):
            own = lambda rows: [tuple(r[:-2]) + (round(r.best_rank, 9), r.has_more) for r in rows.collect()]
            assert own(api.search(segments, episodes, query, page, 5, index)) == own(api.search(segments, episodes, query, page, 5)), (query, page)
        first = next(iter(index.newest_pages(["the", "cat"])))
        read[n] = first.count()
        stored.write(segments.where("episode_id = 0").withColumn("text", F.lit("the cat")))
        assert stored.index().newest is None  # counts hold a dead row: all postings are read
        stored.compact(whole=True)
        assert stored.index().newest is not None
    assert read[600] <= read[60]


def test_an_index_whose_files_are_gone_is_made_anew(spark, tmp_path):
    import shutil

    from scribeflow.plans import search_queries
    from tests.conftest import SMALL

    first = search_queries.stored_index(spark, SMALL)
    assert search_queries.stored_index(spark, SMALL).log.folder == first.log.folder and first.sound()
    name = first.log.read()[1]["segments"][0]["name"]
    shutil.rmtree(f"{first.log.folder.removeprefix('file://')}/data/{name}/terms")
    again = search_queries.stored_index(spark, SMALL)
    assert not first.sound() and again.log.folder != first.log.folder and again.index().match("the").count() > 0


def test_ranks_of_phrases_that_follow_each_other(spark, tmp_path):
    """The query counts as its SQL does, which doesn't see a phrase whose first blank ended the one before."""
    import duckdb

    from scribeflow.plans import registry

    texts = ["the in a in a", "the in a in a in a door", "in a the in a", "in a in a in a in a the", "the door in a", "a in the", "some other words"] + ["nothing of it"] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(db.execute(registry.SQL["ft_bm25_min_rank"]).fetchall())
    assert {r.episode_id: r.best_rank for r in registry.QUERIES["ft_bm25_min_rank"](spark, str(tmp_path)).collect()} == want and len(want) == 5


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_task_sorts_few_postings_and_frequent_terms_take_several(spark, tmp_path, monkeypatch, kind):
    """Ranges are by term and episode, about equally large, and hold what a plain build has."""
    from bisect import bisect_right

    assert textindex.EACH * 100 <= 256 << 20  # bytes that a task sorts
    monkeypatch.setattr(textindex, "EACH", 400)
    rng = random.Random(3)
    rows = [(e, i, " ".join(["the"] * rng.randint(0, 2) + [f"w{rng.randint(0, 300)}" for _ in range(9)]) + " Café") for e in range(150) for i in range(3)] + [(7, 9, None), (8, 9, "")]
    segments = spark.createDataFrame(rows, SCHEMA).withColumn("episode_id", F.col("episode_id").cast(kind))
    want = sorted(map(tuple, textindex.postings(segments).collect()))
    tokens = sum(len(r[3]) for r in want)
    bounds = textindex.range_bounds(segments, 13, len(rows), tokens)
    assert 8 <= len(bounds) <= 12 and bounds == sorted(bounds)
    placed = textindex.postings(segments, bounds).collect()
    assert sorted(tuple(r[:-1]) for r in placed) == want and all(r[-1] == bisect_right(bounds, (r.term, r.episode_id)) for r in placed)
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    index.write(segments)
    files = index.index().postings.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.max(F.col("term") == "the").alias("the")).collect()
    assert sorted(map(tuple, index.index().postings.select("term", "episode_id", "seq", "positions", "dl").collect())) == want
    assert len(files) >= tokens // 400 and max(f.n for f in files) <= 3 * 400
    if kind == "long":
        assert {r.episode_id: r.tokens for r in textindex.episode_lengths(segments).collect()} == {e: sum(len(r[3]) for r in want if r[1] == e) for e in range(150)}


def test_merges_too_are_written_by_small_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "EACH", 300)
    rows = [(e, i, f"the cat number {e} of {i} sat") for e in range(120) for i in range(3)]
    segments, index = spark.createDataFrame(rows, SCHEMA), StoredIndex(spark, f"file://{tmp_path}/i")
    index.write(segments.where("episode_id % 2 = 0"))
    index.write(segments.where("episode_id % 2 = 1 OR episode_id % 10 = 0"))
    index.compact(whole=True)
    assert len(index.log.read()[1]["segments"]) == 1
    files = index.index().postings.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) >= len(rows) * 7 // 300 and max(f["count"] for f in files) <= 3 * 300
    assert rows_of(index.index(), ["the cat"]) == rows_of(textindex.Index.of(segments), ["the cat"])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_large_batch_is_tokenised_once(spark, tmp_path, monkeypatch, kind):
    """Lengths come with the postings, and what plans the tasks is a sample; an episode's segments may lie apart."""
    want_lengths = textindex.episode_lengths
    monkeypatch.setattr(textindex, "episode_lengths", None)  # a second pass over all texts
    for name, value in (("EACH", 400), ("LOOKS", 20), ("ONE_IN", 2), ("RUN", 50)):
        monkeypatch.setattr(textindex, name, value, raising=False)
    rng = random.Random(11)
    rows = [(e, i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in range(6) for e in range(90)] + [(7, 9, None), (8, 9, ""), (95, 0, "")]
    segments = spark.createDataFrame(rows, SCHEMA).withColumn("episode_id", F.col("episode_id").cast(kind)).repartition(3)
    tokens = sum(len(r[3]) for r in textindex.postings(segments).collect())
    tasks, bounds = textindex.planned(segments)
    assert tokens / 400 / 2 <= tasks <= tokens / 400 * 2 and 2 <= len(bounds) < tasks
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    index.write(segments)
    assert sorted(map(tuple, index.index().lengths.collect())) == sorted(map(tuple, want_lengths(segments).select("episode_id", "segments", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()))
    assert sorted(map(tuple, index.index().postings.collect())) == sorted(map(tuple, textindex.postings(segments).collect()))
    assert rows_of(index.index(), ["the cat"]) == rows_of(textindex.Index(textindex.postings(segments), want_lengths(segments)), ["the cat"])
