"""Speech-to-text replies as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.functions import text as T


def from_seconds(replies: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Segments of replies (episode_id, reply: JSON with segments of start, end, text): seconds rounded to ms, text trimmed, empty ones dropped."""
    parsed = F.from_json("reply", "segments array<struct<start: double, end: double, text: string>>")
    rows = replies.select("episode_id", F.posexplode(parsed["segments"]).alias("p", "s"))
    ms = lambda c: F.floor(c * 1000 + 0.5) + offset_ms
    text = T.js_trim(F.col("s.text"))
    return rows.select("episode_id", (F.col("p") + 1).cast("long").alias("seq"), ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), text.alias("text")).where("text <> ''")


def from_offsets(replies: DataFrame) -> DataFrame:
    """Segments of local replies (transcription of offsets.from, offsets.to, text): ASCII texts of three characters or more."""
    parsed = F.from_json("reply", "transcription array<struct<offsets: struct<`from`: long, `to`: long>, text: string>>")
    rows = replies.select("episode_id", F.posexplode(parsed["transcription"]).alias("p", "s"))
    text = T.js_trim(F.col("s.text"))
    out = rows.select("episode_id", (F.col("p") + 1).cast("long").alias("seq"), F.col("s.offsets")["from"].alias("start_ms"), F.col("s.offsets")["to"].alias("end_ms"), text.alias("text"))
    return out.where((F.length("text") >= 3) & T.is_ascii(F.col("text")))
