"""Full-text search against SQLite's own index, paging, windows, samples, vectors."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from scribeflow.operators import textindex, vectors, windows
from scribeflow.plans import api

TEXTS = ["The cat sat on the mat", "the Cat, the dog and the cat", "Café noir, don't stop", "dog cat dog", "cat sat. Cat sat on", "", "and AND or", "the the the the", "naïve cat-like dogs"]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(str(i % 3), i, i * 1000, i * 1000 + 900, t) for i, t in enumerate(TEXTS)], "episode_id string, seq long, start_ms long, end_ms long, text string")


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS)))
    return con


@pytest.mark.parametrize("query", ["cat", "the cat", "dog cat", "cafe", "don't", "AND", "naive", "missing", "cat the dog"])
def test_match_and_rank(segments, fts, query):
    want = {r[0]: r[1] for r in fts.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (" ".join(f'"{w}"' for w in query.split()),))}
    assert {r.seq for r in textindex.match(segments, query).collect()} == set(want)
    got = {r.seq: r["rank"] for r in textindex.bm25(segments, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


@pytest.mark.parametrize("phrase", ["the cat", "cat sat on", "sat on the", "the the"])
def test_phrase(segments, fts, phrase):
    want = {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (f'"{phrase}"',))}
    assert {r.seq for r in textindex.match(segments, [phrase]).collect()} == want
    assert {r.seq for r in textindex.match_postings(textindex.postings(segments), [phrase]).collect()} == want


@pytest.mark.parametrize("query", ["cat", "the cat", "dog cat", "cafe", "don't", ["the cat", "cat sat on"], ["the the"], "missing", "--"])
def test_index_equals_scan(segments, tmp_path, query):
    index = textindex.Index.of(segments).store(str(tmp_path / "index"))
    want = {r.seq: r["rank"] for r in textindex.bm25(segments, query).collect()}
    got = {r.seq: r["rank"] for r in index.bm25(query).collect()}
    assert got.keys() == want.keys() == {r.seq for r in index.match(query).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_index_follows_its_episodes(spark, segments, tmp_path):
    """Episodes removed, replaced and added: as an index of what is left, and of what they are now."""
    same = lambda a, b: sorted(map(str, a.bm25("cat the").collect())) == sorted(map(str, b.bm25("cat the").collect()))
    index = textindex.Index.of(segments).store(str(tmp_path / "index"))
    assert same(index.without(segments.where("episode_id = '1'")), textindex.Index.of(segments.where("episode_id <> '1'")))
    new = spark.createDataFrame([("1", 1, 0, 9, "the cat again"), ("7", 1, 0, 9, "the last cat"), ("8", 1, 0, 9, "")], segments.schema)
    assert same(index.merged(textindex.Index.of(new)), textindex.Index.of(segments.where("episode_id <> '1'").unionByName(new)))


def test_search_by_index_equals_search_by_scan(spark, segments):
    episodes = spark.createDataFrame([(str(i), f"t{i}", 1000, "s") for i in range(3)], "id string, title string, duration_ms long, summary string")
    index = textindex.Index.of(segments)
    for query in ("cat", "the cat", "nothing here", ""):
        for page in (1, 2):
            a, b = (api.search(segments, episodes, query, page, 2, i).drop("best_rank").collect() for i in (None, index))
            assert a == b


def test_no_tokens_match_nothing(segments):
    assert textindex.match(segments, "--").count() == 0 and textindex.bm25(segments, "()").count() == 0


def test_paging_and_has_more(spark, segments):
    episodes = spark.createDataFrame([(str(i), f"t{i}", 1000, "s") for i in range(3)], "id string, title string, duration_ms long, summary string")
    first = api.search(segments, episodes, "cat", page=1, size=2).collect()
    assert [r.episode_id for r in first] == ["2", "1", "1", "1"][: len(first)] or {r.episode_id for r in first} == {"2", "1"}
    assert all(r.has_more for r in first)
    second = api.search(segments, episodes, "cat", page=2, size=2).collect()
    assert {r.episode_id for r in second} == {"0"} and not any(r.has_more for r in second)
    cards = api.search_cards(api.search(segments, episodes, "cat", size=5)).collect()
    assert [c.episode_id for c in cards] == ["2", "1", "0"] and all(c.matches == sorted(c.matches) for c in cards)


def seg(spark, n, make):
    return spark.createDataFrame([("e", i, *make(i)) for i in range(n)], "episode_id string, seq long, start_ms long, end_ms long, text string")


@pytest.mark.parametrize("n", [0, 5, 6, 7, 8, 9, 12, 14])
def test_count_windows(spark, n):
    got = sorted(r["first"] for r in windows.count_windows(seg(spark, n, lambda i: (i, i + 1, f"w{i}"))).collect())
    want = sorted({*range(0, n - 5, 3), n - 6}) if n >= 6 else []
    assert got == want


def test_time_windows_against_a_loop(spark):
    spans = [(0, 30_000), (30_000, 31_000), (44_000, 130_000), (150_000, 151_000), (151_000, 200_000)]
    df = seg(spark, len(spans), lambda i: (*spans[i], f"segment number {i} with some words"))
    got = {(r.window, r.start_ms, r.end_ms, r.text) for r in windows.time_windows(df).collect()}
    want, at = set(), 0
    while at < 200_000:
        own = [i for i, (a, b) in enumerate(spans) if b > at and a < at + 45_000]
        if own:
            want.add((at // 35_000, spans[own[0]][0], spans[own[-1]][1], " ".join(f"segment number {i} with some words" for i in own)))
        at += 35_000
    assert got == want


@pytest.mark.parametrize("n, size", [(10, 5), (200, 6), (200, 200), (50, 3)])
def test_sample(spark, n, size):
    texts = [f"s{i}".ljust(size, "x") for i in range(n)]
    got = windows.sample_text(seg(spark, n, lambda i: (i, i + 1, texts[i]))).first().sample
    if n < 50:
        want = " ".join(texts)
    else:
        skip = min(40, n // 20)
        usable = n - skip
        width = min(200, usable // 5)
        want = " ".join(t for i in range(5) for t in texts[skip + int(usable / 5 * i) :][:width])[:12_000]
    assert got == want and len(got) <= 12_000


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [2.0, 0.0]), ("d", [-1.0, 0.0])], "id string, values array<float>")
    assert [r.id for r in vectors.top_k(df, [3.0, 0.0], 3).collect()] == ["a", "c", "b"]
    unit = {r.id: r["values"] for r in vectors.normalized(df).collect()}
    assert unit["c"] == [1.0, 0.0]
    new = spark.createDataFrame([("a", [9.0, 9.0]), ("z", [1.0, 1.0])], "id string, values array<float>")
    merged = {r.id: r["values"] for r in vectors.upsert(df, new).collect()}
    assert merged["a"] == [9.0, 9.0] and len(merged) == 5
    assert vectors.delete_ids(df, new).count() == 3
    assert df.select(F.size(vectors.hashed_embedding(F.lit("some words")))).first()[0] == 64


def test_embeddings_take_a_pass_over_the_words_whatever_the_width(spark):
    import time

    def plain(text, width):  # place by place
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        code = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)) * 2 + F.when(F.xxhash64(w, F.lit(1)) < 0, 1).otherwise(0))
        at = lambda i: F.aggregate(code, F.lit(0.0), lambda s, c: s + F.when(c == 2 * i, 1.0).when(c == 2 * i + 1, -1.0).otherwise(0.0))
        return F.array(*map(at, range(width)))

    texts = [None, "", " - ", "a", "the The THE cat", "Größe 東京 x1 ½ cat", "one two three " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(vectors.hashed_embedding(F.col("text"), 7).alias("own"), plain(F.col("text"), 7).alias("want")).collect()
    assert all(r.own == r.want for r in rows) and rows[0].own == [None] * 7 and rows[1].own == [0.0] * 7
    long = spark.range(200).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), i * 7919 + F.col("id")))).alias("text"))
    took = []
    for width in (8, 8, 2048):
        began = time.time()
        long.select(F.size(F.filter(vectors.hashed_embedding(F.col("text"), width), lambda v: v != 0)).alias("n")).agg(F.sum("n")).collect()
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 4
