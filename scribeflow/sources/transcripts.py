"""Transcript documents: one JSON file an episode, or files of JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scribeflow.model import TRANSCRIPT


def _parsed(piece: Column) -> Column:
    """The document that piece holds; _corrupt is set if it isn't one."""
    return F.from_json(piece, TRANSCRIPT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _sound(doc: Column) -> Column:
    return doc.isNotNull() & doc["_corrupt"].isNull()


def _pieces(reader, folder: str) -> DataFrame:
    """stem, line (1-based; null: the file is one document), content, doc, sound of each document in a folder's files.

    A file whose first line is a whole document is a file of JSON lines; any other is one document.
    """
    files = reader.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = F.coalesce(F.size(lines) > 1, F.lit(False)) & _sound(_parsed(F.get(lines, F.lit(0))))
    rows = files.select(stem.alias("stem"), F.posexplode(F.when(by_line, lines).otherwise(F.array("value"))).alias("at", "content"), by_line.alias("lined"))
    doc = _parsed(F.col("content"))
    return rows.select("stem", F.when(F.col("lined"), F.col("at") + 1).alias("line"), "content", doc.alias("doc")).withColumn("sound", _sound(F.col("doc")))


def _documents(reader, folder: str) -> DataFrame:
    rows = _pieces(reader, folder).where("sound")
    name = F.when(F.col("line").isNull(), F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("line").cast("string")))
    none = F.array().cast("array<struct<start_ms: bigint, end_ms: bigint, text: string>>")
    rows = rows.select(F.coalesce("doc.episode_id", name).alias("episode_id"), "doc.title", F.coalesce("doc.segments", none).alias("segments"))
    return rows.select("episode_id", F.coalesce("title", "episode_id").alias("title"), "segments")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """episode_id, title, segments of each document in a folder's files (*.json: a document each, or JSON lines).

    What can't be read is left out, and is in broken_transcripts. Missing segments are none; a missing id is the
    file's stem, with the number of the line among those of its file if it has several. An empty file has no document.
    """
    return _documents(spark.read, folder)


def broken_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, line (null: the whole file), content of what read_transcripts leaves out."""
    return _pieces(spark.read, folder).where("NOT sound").select("stem", "line", "content")


def stream_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """read_transcripts as a stream of the files that land in a folder."""
    return _documents(spark.readStream, folder)


def segments_of(transcripts: DataFrame) -> DataFrame:
    """episode_id, seq (1-based), start_ms, end_ms, text."""
    rows = transcripts.select("episode_id", F.posexplode("segments").alias("p", "s"))
    return rows.select("episode_id", (F.col("p") + 1).cast("long").alias("seq"), "s.start_ms", "s.end_ms", "s.text")


def write_transcripts(segments: DataFrame, episodes: DataFrame, folder: str) -> int:
    """A file <id>.json for each episode with segments, segments in order; returns how many.

    Characters that file names can't hold are percent-encoded in them; the document has the id as it is. A file is
    written under another name and then moved, so a task that runs again, or a reader meanwhile, meets whole files only.
    """
    line = F.struct("seq", "start_ms", "end_ms", "text")
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda s: F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["text"].alias("text")))
    docs = segments.where("episode_id IS NOT NULL").groupBy("episode_id").agg(ordered.alias("segments"))
    titled = docs.join(episodes.select(F.col("id").alias("episode_id"), "title"), "episode_id", "left")
    text = F.to_json(F.struct(F.col("episode_id").cast("string").alias("episode_id"), "title", "segments"))
    kind = StructType.fromDDL("files long")
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place = f"{base}/{quote(name, safe=' ')}.json"
                with store.open_output_stream(f"{place}.tmp", compression=None) as f:
                    f.write(doc.encode("utf-8", "surrogatepass"))
                store.move(f"{place}.tmp", place)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], schema=out)

    return titled.select(F.col("episode_id").cast("string"), text).mapInArrow(run, kind).agg(F.sum("files")).first()[0] or 0
