"""Small helpers for mapInArrow and applyInArrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def schema(spark: SparkSession | None, ddl: str) -> tuple[StructType, pa.Schema]:
    """The Spark and the Arrow form of a schema in DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(ddl)
    return kind, to_arrow_schema(kind)


@cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another system's allocator is left to itself
        return None


def settled(run: Callable) -> Callable:
    """run, after which the worker gives the memory that is free back to the system: workers live on from task to task."""

    @wraps(run)
    def own(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if _libc() is not None:
                _libc().malloc_trim(0)

    return own


def batch(kind: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def filtered(docs: DataFrame, text: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text keep (many texts -> flags) lets pass."""
    at = docs.columns.index(text)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def replaced(docs: DataFrame, text: str, change: Callable[[list], list]) -> DataFrame:
    """docs with each text changed; the other columns as they are."""
    at = docs.columns.index(text)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield part.set_column(at, part.schema.field(at), pa.array(change(part.column(at).to_pylist()), part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
