"""Recall of the trees of the near-duplicate join where every node branches through all levels."""

import numpy as np
import pytest

from scribeflow.llm import ann, neardup


@pytest.mark.parametrize("similarity", [0.85, 0.8])
def test_paths_of_pairs_at_the_threshold(spark, similarity):
    rng = np.random.default_rng(int(100 * similarity))
    pairs = 800
    x = rng.integers(0, 2**32, (pairs, neardup.TOKENS), np.uint32)
    y = np.where(rng.random(x.shape) < similarity, x, rng.integers(0, 2**32, x.shape, np.uint32)).astype(np.uint32)
    reps = spark.createDataFrame([(int(i), s.tobytes()) for i, s in enumerate(np.concatenate([x, y]))], "doc long, sketch binary").cache()
    rows = neardup._root_paths(reps, similarity)
    for _ in range(neardup.DEPTH):
        rows = neardup._branches(rows.join(reps, "doc"), similarity)
    shared = rows.selectExpr("node", f"doc % {pairs} AS pair", "doc").distinct().groupBy("node", "pair").count()
    met = shared.where("count > 1").select("pair").distinct().count()
    assert met / pairs >= neardup.RECALL - 3 * (0.01 / pairs) ** 0.5


def test_number_of_trees():
    assert neardup.trees(1.0) == 1 and neardup.trees(0.95) < neardup.trees(0.85) < neardup.trees(0.8)


def test_each_length_is_searched_among_its_own(spark):
    """Vectors of two lengths: the neighbours of each are those of its length, however many the other has."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=6).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 10 = 0"), k=3).collect()
    assert {r.query_id for r in got} == {*range(0, 60, 10), 100, 110} and len(got) == 24
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for q in {r.query_id for r in got}:
        want = sorted((i for i in unit if i != q and len(unit[i]) == len(unit[q])), key=lambda i: -float(unit[i] @ unit[q]))[:3]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
