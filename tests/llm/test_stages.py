"""Each pipeline stage and the whole pipeline on odd rows: nulls, empty texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

#: Extra columns that clash with names that operators use.
CLASH = ["score", "key", "spans", "grp", "doc", "node", "kept", "row", "place", "id", "bucket", "bit", "map", "_bucket", "_bit", "_Map", "gone", "count", "r"]
STAGES = dict(cp.STAGES)
N = 400


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows beside some plain ones, in which toxic words and benchmark passages were planted."""
    d = str(tmp_path_factory.mktemp("odd"))
    plain = lambda i: " ".join(f"w{i * 40 + j}" for j in range(40))
    rows = [(i, plain(i) + (" vile zork" if i % 5 == 0 else ""), "en", "s") for i in range(N)]
    rows += [(1200, plain(9000) + " once upon a benchmark there was a passage of twelve words here", None, "s"), (1201, plain(9010) + " mail me at joe@x.org", None, None), (1202, plain(31)[:-4], "en", "s")]
    rows += [(None, None, None, None), (None, "a text of its own", None, None), (1300, None, "en", "s"), (1301, "", "en", "s"), (1302, "", "en", "s"), (1303, "  \n", "en", "s"), (1304, plain(9020), "x", "s"), (1304, plain(9020), "x", "s"), (1304, plain(9030), "x", None), (1305, "lone " * 60_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs = docs.withColumns({c: F.lit("clash") for c in CLASH})
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, None, int(i % 5 == 0)) for i in range(N) if i != 31] + [(1, None, None), (None, 1, 1), (10**6, 0, 1), (2, 1, 0), (2, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, "Once upon a benchmark there was a passage of twelve words here"), (2, None), (None, "x y"), (3, ""), (1, "Once upon a benchmark there was a passage of twelve words here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda i: (i is None, i))
    all_ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda i: (i is None, i))
    if name != "byte_bpe":
        assert out.columns == docs.columns
    if name == "toxicity":
        assert {*range(N)} - set(ids) == {i for i in range(N) if i % 5 == 0} and [i for i in all_ids if i is None or i >= 1000] == [i for i in ids if i is None or i >= 1000]
    elif name == "near_dedup":
        assert ids == [i for i in sorted({i for i in all_ids if i is not None}) if i != 1202] + [None, None]
        assert [r.text for r in out.where("doc_id = 1304").collect()] == [min(r.text for r in docs.where("doc_id = 1304").collect())]
    elif name == "decontamination":
        assert ids == [i for i in all_ids if i != 1200]
    else:
        assert ids == all_ids
    if name == "pii":
        assert out.where("doc_id = 1201").first().text.endswith("mail me at [EMAIL]")
        assert out.where("text IS NULL").count() == docs.where("text IS NULL").count() and out.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_no_rows(spark, folder, tmp_path, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert STAGES[name](spark, docs, str(tmp_path)).count() == 0


def test_whole_run(spark, folder):
    got = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert got == {None, *(i for i in range(N) if i % 5), 1201, 1300, 1301, 1302, 1303, 1304, 1305}
