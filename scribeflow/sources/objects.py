"""Objects in a store: written from rows, listed by size, and read by ranges of bytes.

Each range is read by the task that holds its row: the store is asked for just
these bytes, so one large object is read by many tasks and nothing else of it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from scribeflow.functions import formats as X
from scribeflow.operators import windows
from scribeflow.runtime import written


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _place(base: str, key: str) -> str:
    return f"{base}/{quote(key, safe='')}"


def put(rows: DataFrame, folder: str, key: str = "key", body: str = "body") -> DataFrame:
    """Writes an object for each row and returns key and size of each.

    A body is text (UTF-8) or bytes; a null body is empty, rows without a key are left out; of equal keys one, the
    last that is written, stays. An object is written under another name and then moved, so readers meet whole ones.
    """
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("body"))
    kind = StructType.fromDDL("key string, size long")
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                place = _place(base, name)
                with store.open_output_stream(f"{place}.part", compression=None) as f:
                    f.write(data.as_buffer())
                store.move(f"{place}.part", place)
            sizes = pa.array([len(x.as_buffer()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes], schema=out)

    return written(own.mapInArrow(run, kind), "objects")


def read_ranges(ranges: DataFrame, folder: str) -> DataFrame:
    """ranges (key, first, length, ...) with bytes: those of the object from first on, fewer where it ends before; null if there is no such object."""
    kind = StructType([*ranges.schema.fields, StructField("bytes", BinaryType())])
    out = to_arrow_schema(kind)
    at = [ranges.columns.index(c) for c in ("key", "first", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for b in batches:
            for i in range(0, b.num_rows, 16):  # bytes of a few ranges at a time
                part = b.slice(i, 16)
                got = []
                for key, first, length in zip(*(part.column(c).to_pylist() for c in at), strict=True):
                    try:
                        with store.open_input_file(_place(base, key)) as f:
                            f.seek(min(first, f.size()))
                            got.append(f.read(max(0, length)))
                    except (FileNotFoundError, TypeError):  # no such object, or no key
                        got.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], schema=out)

    return ranges.mapInArrow(run, kind)


def chunks(objects: DataFrame, folder: str, chunk: int = 20 * 1024 * 1024) -> DataFrame:
    """key, part, first, length, bytes of every object (key, size), chunk bytes a row: rows are dealt over tasks by key and part."""
    ranges = windows.byte_ranges(objects, chunk)
    return read_ranges(ranges.repartition("key", "part"), folder)


def answers(requests: DataFrame, objects: DataFrame, folder: str) -> DataFrame:
    """requests (id, key, header: null or a Range header) with status, content_range, bytes, as a server of the objects gives them.

    404 for an unknown object or a key that isn't allowed; 206 with the range's bytes and place; without a range that can be
    read, 200 and the whole object. A range without an end goes to the object's; beyond the end there are no bytes.
    """
    ask = X.byte_range(F.col("header"))
    rows = requests.join(objects.select(F.col("key").alias("_key"), F.col("size").alias("_size")), F.col("key") == F.col("_key"), "left")
    rows = rows.withColumns({"_first": ask["first"], "_last": ask["last"]})
    known = F.col("_size").isNotNull() & X.audio_key(F.col("key"))
    ranged = F.col("_first").isNotNull()
    length = F.when(~ranged, F.col("_size")).otherwise(F.coalesce(F.col("_last"), F.col("_size") - 1) - F.col("_first") + 1)
    rows = rows.withColumns({"first": F.coalesce("_first", F.lit(0)).cast("long"), "length": F.greatest(F.lit(0), length).cast("long")})
    status = F.when(~known, 404).when(ranged, 206).otherwise(200)
    place = F.concat(F.lit("bytes "), F.col("first"), F.lit("-"), F.col("first") + F.col("length") - 1, F.lit("/"), F.col("_size"))
    rows = rows.select("id", "key", F.when(known, F.col("first")).otherwise(0).alias("first"), F.when(known, F.col("length")).otherwise(0).alias("length"), status.alias("status"), F.when(known & ranged, place).alias("content_range"))
    got = read_ranges(rows, folder)
    return got.select("id", "key", "status", "content_range", F.when(F.col("status") != 404, F.col("bytes")).alias("bytes"))
