"""Keyed tables: changes against plain dictionaries, files that stay, failures, versions."""

import random

import pytest
from pyspark.sql import functions as F

from scribeflow.operators.keyed import KeyedTable

SCHEMA = "id long, title string, n int"


def table_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def got(t):
    return sorted(map(tuple, t.rows().collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    state = {i: (i, f"t{i}", i) for i in range(40)}
    t = KeyedTable.create(table_of(spark, list(state.values())), f"file://{tmp_path}/t", ["id"], 8)
    for step in range(6):
        ids = [rng.choice([None, *range(60)]) for _ in range(rng.randint(1, 7))]
        new = [(i, rng.choice(["", None, "new"]), rng.randint(0, 9)) for i in ids]
        last = {i: max((r for r in new if r[0] == i), key=lambda r: (r[1] is not None, r[1] or "", r[2])) for i in ids}
        kind = ["upsert", "insert_ignore", "patch", "delete"][step % 4]
        if kind == "upsert":
            state |= last
            t.upsert(table_of(spark, new))
        elif kind == "insert_ignore":
            state = last | state
            t.insert_ignore(table_of(spark, new))
        elif kind == "patch":
            state |= {i: (i, r[1] or state[i][1], r[2]) for i, r in last.items() if i in state}
            t.patch(table_of(spark, new), only_if_present=("title",))
        else:
            state = {i: r for i, r in state.items() if i not in ids}
            t.delete(table_of(spark, [(i,) for i in ids], "id long"))
        assert got(t) == sorted(state.values(), key=str)


def test_other_buckets_keep_their_files(spark, tmp_path):
    t = KeyedTable.create(table_of(spark, [(i, "x", 0) for i in range(100)]), f"file://{tmp_path}/t", ["id"], 16)
    files = lambda: {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"file://{tmp_path}/t/data").select("path").collect()}
    before, listed = files(), t.log.read()[1]["files"]
    t.upsert(table_of(spark, [(5, "y", 1)]))
    now = t.log.read()[1]["files"]
    assert sum(now[b] != listed[b] for b in now) == 1 and before < files() and len(files()) == len(before) + 1
    assert t.rows(1).where("title = 'y'").count() == 0 and t.rows().where("title = 'y'").count() == 1
    assert len(t.vacuum()) == 1 and len(files()) == len(before) and t.rows().count() == 100
    assert t.delete(table_of(spark, [], "id long")) == 2


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    t = KeyedTable.create(table_of(spark, [(1, "a", 1), (2, "b", 2)]), f"file://{tmp_path}/t", ["id"], 4)
    with pytest.raises(Exception, match="broken"):
        t.change(table_of(spark, [(1,)], "id long"), lambda old: old.withColumn("title", F.when(F.raise_error(F.lit("broken")).isNull(), "x")))
    with pytest.raises(ValueError):
        t.change(table_of(spark, [(1,)], "id long"), lambda old: table_of(spark, [(i, "z", 0) for i in range(50)]))
    assert got(t) == [(1, "a", 1), (2, "b", 2)] and t.log.versions() == [1]
    with pytest.raises(ValueError):
        KeyedTable.create(table_of(spark, []), f"file://{tmp_path}/t", ["id"], 4)


def test_replace_and_rename_of_links(spark, tmp_path):
    links = [(1, "Ann"), (1, "Bob"), (2, "Ann"), (3, None), (3, "Cy")]
    t = KeyedTable.create(table_of(spark, links, "episode_id long, guest string"), f"file://{tmp_path}/a", ["episode_id"], 4)
    t.replace(table_of(spark, [(1, "Dee"), (1, "Eve"), (9, "Flo")], "episode_id long, guest string"))
    assert got(t) == sorted([(1, "Dee"), (1, "Eve"), (9, "Flo"), *links[2:]], key=str)
    with pytest.raises(ValueError):
        t.rename(table_of(spark, [("Ann", "Ada")], "old string, new string"), table_of(spark, [], "old string"), "guest")
    by_guest = KeyedTable.create(table_of(spark, links, "episode_id long, guest string"), f"file://{tmp_path}/b", ["guest"], 4)
    by_guest.rename(table_of(spark, [("Ann", "Bob")], "old string, new string"), table_of(spark, [("Cy",)], "old string"), "guest")
    assert got(by_guest) == sorted([(1, "Bob"), (2, "Bob"), (3, None)], key=str)


def test_one_key_with_most_rows(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3 * 0 + F.when(F.col("id") < 2000, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    t = KeyedTable.create(rows, f"file://{tmp_path}/t", ["k"], 8)
    t.delete(spark.createDataFrame([(2500,)], "k long"))
    assert t.rows().count() == 2999 and t.rows().where("k = 7").count() == 2000
