"""Listings of recordings and upload events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def audio_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """filename, size, born of the .mp3 files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1)
    rows = files.select(name.alias("filename"), F.col("length").alias("size"), F.to_date("modificationTime").alias("born"))
    return rows.where(F.lower("filename").endswith(".mp3") & (~F.col("filename").isin(*skip) if skip else F.lit(True)))


def audio_events(events: DataFrame) -> DataFrame:
    """key, size of upload events (value: JSON with object.key and object.size) of .mp3 files, batch or stream."""
    parsed = F.from_json("value", "object struct<key: string, size: long>")
    rows = events.select(parsed["object"].alias("o")).select("o.key", "o.size")
    return rows.where(F.col("key").isNotNull() & (F.col("key") != "") & F.lower("key").endswith(".mp3"))
