"""Operator 13: centroid clustering of vectors, with annulus search for the nearest centroid.

Vectors become whole numbers (floor of scale times each component), so every
distance, mean and tie is exact. By the triangle inequality a centroid within
distance u of a vector has a norm within u of the vector's norm. So centroids
are sorted by norm, u is the distance to the centroid that the vector had
before (at first: the one with the nearest norm), a binary search finds the
centroids in that annulus, and only those are compared. The annulus is widened
by more than the rounding of its square roots, so centroids on its border,
which may tie, are compared too.

Rounds pass through tables in the shared folder. A task keeps one sum for each
centroid; sums meet by centroid and component. Only centroids (k times dims
numbers) reach the driver and the tasks.

Defined cases: vectors that are null, of another length, or hold null or
non-finite components take no part and have no row; rows without vec_id and
repeated rows take part as vectors of their own (an absent id is hashed as
`1:`); rows of one id that tie as first centroids are ordered by their
components; with fewer than k vectors each is a centroid; components beyond
LARGEST count as LARGEST, so that squared distances fit a long, and an inertia
that doesn't fit one is null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow
from scribeflow.runtime import Scratch, written

#: Components after scaling are at most this far from 0.
LARGEST = 1 << 27
#: Numbers that one comparison of vectors with candidates lays out at once.
BLOCK = 1 << 22
_LONG = 1 << 63


def whole_numbers(vectors: DataFrame, vec: str, dims: int, scale: int) -> DataFrame:
    """vec_id and v (dims integers) of the rows whose vector takes part."""
    x = F.col(vec).cast("array<double>")
    fits = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    cell = lambda a: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-2.0 * LARGEST), F.least(F.lit(2.0 * LARGEST), a * scale)))))
    return vectors.where((F.size(x) == dims) & fits).select(F.col("vec_id").cast("long"), F.transform(x, lambda a: cell(a).cast("int")).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray | None = None, compared: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of x (int64); ties: the smaller number."""
    norms = np.sqrt((centroids * centroids).sum(1))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((x * x).sum(1))
    if before is None:
        at = np.searchsorted(norms, own)
        low, high = np.maximum(at - 1, 0), np.minimum(at, len(norms) - 1)
        before = order[np.where(own - norms[low] <= norms[high] - own, low, high)]
    reach = np.sqrt(((x - centroids[before]) ** 2).sum(1))
    reach += 1e-9 * (reach + own) + 1e-6
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    count = high - low
    if compared is not None:
        compared.append(int(count.sum()))
    who, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends = np.cumsum(count)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + max(1, BLOCK // x.shape[1]), "right")))
        starts = ends[i:j] - count[i:j] - (ends[i - 1] if i else 0)
        rows = np.repeat(np.arange(i, j), count[i:j])
        found = order[np.arange(len(rows)) - np.repeat(starts - low[i:j], count[i:j])]
        d = ((x[rows] - centroids[found]) ** 2).sum(1)
        best[i:j] = np.minimum.reduceat(d, starts)
        who[i:j] = np.minimum.reduceat(np.where(d == best[rows], found, len(norms)), starts)
        i = j
    return who, best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def _assigned(rows: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    """rows (vec_id, v, and cluster unless first) with the nearest centroid's number and its squared distance."""
    kind, out = arrow.schema(None, "vec_id long, v array<int>, cluster int, distance long")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                who, d = nearest(_matrix(b.column(1)), centroids, None if first else b.column(2).to_numpy())
                yield arrow.batch(out, b.column(0), b.column(1).cast(out.field("v").type), who.astype(np.int32), d)

    return rows.mapInArrow(run, kind)


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' floor of sum over count, component by component; a centroid without vectors stays."""
    k, dims = centroids.shape
    kind, out = arrow.schema(None, "cluster int, n long, s array<long>")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if b.num_rows:
                who = b.column(0).to_numpy()
                n += np.bincount(who, minlength=k)
                by = np.argsort(who, kind="stable")
                got, first = np.unique(who[by], return_index=True)
                s[got] += np.add.reduceat(_matrix(b.column(1))[by], first)
        some = np.flatnonzero(n)
        yield arrow.batch(out, some.astype(np.int32), n[some], s[some].tolist())

    parts = assigned.select("cluster", "v").mapInArrow(run, kind)
    exact = F.col("x").cast("decimal(38,0)")
    sums = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(exact).alias("s"), F.sum("n").alias("n"))
    new = centroids.copy()
    for c, pos, s, n in sums.collect():  # at most k times dims rows
        new[c, pos] = int(s) // n
    return new


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.written(whole_numbers(vectors, vec, dims, scale), "vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "v").limit(k).collect()
    if not first:
        scratch.clear()
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    for r in range(rounds):
        rows = scratch.written(_assigned(rows, centroids, r == 0), "assigned")
        centroids = _means(rows, centroids)
    final = _assigned(rows, centroids, rounds == 0).select("vec_id", "cluster", "distance")
    final = written(final, "clusters")
    scratch.clear()
    spread = {c: int(s) for c, s in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # at most k rows
    fits = lambda s: s if s < _LONG else None
    total = fits(sum(spread.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    info = [(c, fits(s), total, digest(c)) for c, s in sorted(spread.items())]
    about = spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
