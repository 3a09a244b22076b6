"""Sliding windows, chunks, samples and offsets over ordered segments.

Each segment is sent to the windows that hold it, by arithmetic on its place
or time, and windows are groups: interval joins become equi groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import text as T


def joined_text(order: str = "seq", sep: str = " ") -> Column:
    """The texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), sep)


def count_windows(segments: DataFrame, size: int = 6, stride: int = 3) -> DataFrame:
    """episode_id, first (0-based), start_ms, end_ms, text of windows of size segments every stride, and of the last size."""
    placed = segments.withColumns({"_p": F.row_number().over(W.partitionBy("episode_id").orderBy("seq")) - 1, "_n": F.count("*").over(W.partitionBy("episode_id"))}).where(F.col("_n") >= size)
    last = F.col("_n") - size
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - (size - 1)) / stride).cast("int"))
    high = F.least(F.floor(F.col("_p") / stride), F.floor(last / stride)).cast("int")
    none = F.array().cast("array<bigint>")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * stride).cast("long"))).otherwise(none)
    tail = F.when(F.col("_p") >= last, F.array(last.cast("long"))).otherwise(none)
    rows = placed.withColumn("first", F.explode(F.array_union(regular, tail)))
    return rows.groupBy("episode_id", "first").agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), joined_text().alias("text"))


def time_windows(segments: DataFrame, window_ms: int = 45_000, step_ms: int = 35_000, durations: DataFrame | None = None) -> DataFrame:
    """episode_id, window, id, start_ms, end_ms, text of the chunks of each episode that are worth embedding.

    A segment belongs to each window that it overlaps (half-open). Windows
    start every step until the duration (durations: episode_id, duration_ms;
    else the last end). A chunk starts with its first segment; chunks that
    aren't ASCII or have under 20 characters are left out.
    """
    if durations is None:
        rows = segments.withColumn("_d", F.max("end_ms").over(W.partitionBy("episode_id")))
    else:
        rows = segments.join(durations.select("episode_id", F.col("duration_ms").alias("_d")), "episode_id")
    low = F.greatest(F.lit(0), F.floor((F.col("start_ms") - window_ms) / step_ms) + 1)
    high = F.least(F.ceil(F.col("end_ms") / step_ms) - 1, F.ceil(F.col("_d") / step_ms) - 1)
    rows = rows.where(low <= high).withColumn("window", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    chunks = rows.groupBy("episode_id", "window").agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), joined_text().alias("text"))
    chunks = chunks.where(T.is_ascii(F.col("text")) & (F.length(T.js_trim(F.col("text"))) >= 20))
    return chunks.select("episode_id", "window", F.concat("episode_id", F.lit(":"), "start_ms").alias("id"), "start_ms", "end_ms", "text")


def last_per_id(chunks: DataFrame, key: str = "id", order: str = "window") -> DataFrame:
    """The last row of each id: what is left when later writes replace earlier ones."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return chunks.withColumn("_r", rank).where("_r = 1").drop("_r")


def sample_text(segments: DataFrame, small: int = 50, windows: int = 5, widest: int = 200, skip_share: float = 0.05, most_skipped: int = 40, cut: int = 12_000) -> DataFrame:
    """episode_id, sample: all of a short episode, else evenly spread runs after the opening; cut to a length."""
    p = F.row_number().over(W.partitionBy("episode_id").orderBy("seq")) - 1
    rows = segments.withColumns({"_p": p, "_n": F.count("*").over(W.partitionBy("episode_id"))})
    skip = F.least(F.lit(most_skipped), F.floor(F.col("_n") * skip_share))
    usable = F.col("_n") - skip
    width = F.least(F.lit(widest), F.floor(usable / windows))
    within = F.lit(False)
    for i in range(windows):
        start = skip + F.floor(usable / windows * i)
        within = within | ((F.col("_p") >= start) & (F.col("_p") < start + width))
    rows = rows.where((F.col("_n") < small) | within)
    return rows.groupBy("episode_id").agg(F.substring(joined_text(), 1, cut).alias("sample"))


def chunk_offsets(chunks: DataFrame, key: str = "episode_id", order: str = "chunk", duration: str = "duration_ms") -> DataFrame:
    """chunks with offset_ms: the durations before each."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("offset_ms", F.coalesce(F.sum(duration).over(before), F.lit(0)))


def byte_ranges(objects: DataFrame, chunk: int = 20 * 1024 * 1024) -> DataFrame:
    """key, part, first, length: the ranges in which an object of size bytes is read."""
    rows = objects.where("size > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))))
    return rows.select("key", "part", (F.col("part") * chunk).alias("first"), F.least(F.lit(chunk), F.col("size") - F.col("part") * chunk).alias("length"))


def batches(rows: DataFrame, size: int, order: str, by: str) -> DataFrame:
    """rows with batch: numbers of size rows each, in order, within each value of by."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size))
