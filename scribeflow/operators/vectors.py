"""Exact vector search: unit vectors once, top k by cosine, hits by episode, upserts."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalized(vectors: DataFrame, values: str = "values") -> DataFrame:
    """vectors of length 1 in double precision, to be stored once."""
    v = F.col(values)
    norm = F.sqrt(dot(v, v))
    return vectors.withColumn(values, F.transform(v, lambda x: x.cast("double") / norm))


def top_k(vectors: DataFrame, query: list[float], k: int = 20, values: str = "values", key: str = "id") -> DataFrame:
    """The k vectors nearest to query, with score; ties go to the smaller id. Each task keeps k, one merges."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(values), q)).orderBy(F.desc("score"), key).limit(k)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """stored with the rows of new in place of those with the same id."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete_ids(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """An offline stand-in for an embedding model: signed counts of hashed words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    code = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)) * 2 + F.when(F.xxhash64(w, F.lit(1)) < 0, 1).otherwise(0))
    return _signed_counts(width)(code)


@cache
def _signed_counts(width: int):
    """Of codes, place * 2 and 1 where it counts down: the sums of width places, a pass over the codes for all of them. Null: all places null."""

    @F.arrow_udf("array<double>")
    def counts(codes: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(codes), 0)).astype(np.int64)
        own = np.asarray(codes.flatten()).astype(np.int64)
        at = np.repeat(np.arange(len(size)) * width, size) + own // 2
        sums = np.bincount(at, np.where(own % 2, -1.0, 1.0), len(size) * width)
        none = np.repeat(np.asarray(pc.is_null(codes)), width)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * width, pa.int32()), pa.array(sums, mask=none))

    return counts
