"""Centroid clustering: the annulus search against all distances, and whole runs against a plain loop."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribeflow.llm import annulus


def exact(x, c):
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)  # argmin takes the first: the smaller number


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.sampled_from([1, 2, 64]), st.sampled_from([1, 3, 1000, 1 << 27]))
def test_nearest_is_that_of_all_distances(seed, k, n, dims, size):
    rng = np.random.default_rng(seed)
    c = rng.integers(-size, size + 1, (k, dims))
    x = np.concatenate([rng.integers(-size, size + 1, (n, dims)), c])  # some lie on centroids: ties at distance 0 too
    want = exact(x, c)
    for before in (None, rng.integers(0, k, len(x))):
        got = annulus.nearest(x, c, before)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_border_ties_and_small_blocks(monkeypatch):
    monkeypatch.setattr(annulus, "BLOCK", 8)
    c = np.array([[2, 0], [-2, 0], [0, 2], [0, 0], [4, 0]])
    x = np.array([[0, 0], [1, 0], [3, 0], [1, 1], [0, 1]])
    got = annulus.nearest(x, c)
    assert got[0].tolist() == exact(x, c)[0].tolist()
    assert annulus.nearest(np.array([[1, 1]]), np.array([[0, 2], [2, 0]]))[0].tolist() == [0]


def test_far_centroids_are_not_compared():
    rng = np.random.default_rng(0)
    middle = np.arange(1, 201)[:, None] * 1000
    c = np.concatenate([middle, np.zeros((200, 3), int)], 1)
    x = c[rng.integers(0, 200, 500)] + rng.integers(-5, 6, (500, 4))
    seen = []
    annulus.nearest(x, c, None, seen)
    assert seen[0] < 500 * 4  # of 100,000 pairs


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    keep = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    by = sorted(keep, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in keep:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    last = [(i, *near(v)) for i, v in keep]
    inertia = lambda j: sum(d for _, d, g in last if g == j)
    sha = lambda m: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()
    return sorted(((i, j, d, inertia(j), sum(x[1] for x in last), sha(c[j])) for i, d, j in last), key=str)


def asked(df, **more):
    return sorted((tuple(r) for r in annulus.cluster(df, **more).collect()), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows_against_a_plain_loop(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.4, 64)]) for i in range(150)]
    rows += [(200, None), (201, [0.5] * 63), (202, [0.5] * 65), (203, [0.5] * 63 + [float("nan")]), (204, [0.5] * 63 + [float("inf")]), (205, [0.5] * 63 + [None]), (206, []), (207, [0.0] * 64), (208, [-0.0] * 64), (209, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, [-0.015625] * 64), (None, [-0.015] * 64)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("clash") for c in ("v", "cluster", "distance", "n", "s", "pos")})
    assert asked(df.repartition(3)) == plain(rows)
    assert asked(df.limit(0)) == [] and asked(df.where("vec_id = 201")) == []


def test_few_vectors_copies_and_other_sizes(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(50, [9.0, -3.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, rounds in ((16, 3), (2, 0), (100, 1)):
        assert asked(df, k=k, rounds=rounds, dims=2, scale=2) == plain(rows, k, rounds, 2, 2)


def test_huge_components_do_not_overflow(spark):
    rows = [(1, [1e300, -1e300]), (2, [3.0, 4.0]), (3, [-1e30, 1e30])]
    got = annulus.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=1, dims=2).collect()
    assert len(got) == 3 and all(r.distance >= 0 and r.inertia >= r.distance for r in got)
