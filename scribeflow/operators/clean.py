"""Cleaning of transcript segments, quality gates and the start of the guest's part.

Segments: episode_id, seq (order in the episode), start_ms, end_ms, text.
All windows run within one episode, so one shuffle by episode serves a whole
cleaning pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import text as T


def _episode() -> WindowSpec:
    return W.partitionBy("episode_id")


def _in_order() -> WindowSpec:
    return W.partitionBy("episode_id").orderBy("seq")


def phrase_key(text: Column) -> Column:
    return F.lower(T.js_trim(text))


def _frequent_short(least: int, share: float) -> Column:
    """Phrases of at most three words that come more often than max(least, share of the episode's segments)."""
    short = T.word_count(F.col("text")) <= 3
    times = F.count_if(short).over(W.partitionBy("episode_id", phrase_key(F.col("text"))))
    limit = F.greatest(F.lit(least), F.floor(F.count("*").over(_episode()) * share))
    return short & (times > limit)


def clean_segments(segments: DataFrame, variant: str = "pipeline", corrections: dict[str, str] | None = None, least: int = 10, share: float = 0.02) -> DataFrame:
    """Segments without artefacts: no duration, repeats of the last kept text, loops, frequent short phrases.

    Variant `pipeline` counts phrases on all rows first and corrects the host's
    name; `scripts` corrects words first and counts on what is left at the end.
    """
    if variant == "pipeline":
        kept = segments.withColumn("_noise", _frequent_short(least, share)).where("start_ms <> end_ms AND NOT _noise").where(~T.has_internal_loop(F.col("text")))
        kept = kept.withColumn("_last", F.lag("text").over(_in_order())).where("_last IS NULL OR _last <> text")
        return kept.withColumn("text", T.fix_host(F.col("text"))).select(segments.columns)
    kept = segments.withColumn("text", T.correct_words(F.col("text"), corrections or {})).where("start_ms <> end_ms").where(~T.has_internal_loop(F.col("text")))
    kept = kept.withColumn("_last", F.lag("text").over(_in_order())).where("_last IS NULL OR _last <> text")
    return kept.withColumn("_noise", _frequent_short(least, share)).where("NOT _noise").select(segments.columns)


def repeated_phrases(segments: DataFrame, times: int = 20, length: int = 20) -> DataFrame:
    """episode_id, text, cnt of texts longer than length that an episode repeats more than times."""
    return segments.where(F.length("text") > length).groupBy("episode_id", "text").agg(F.count("*").alias("cnt")).where(F.col("cnt") > times)


def purge_phrases(segments: DataFrame, times: int = 20, length: int = 20) -> DataFrame:
    """Segments without the repeated phrases of their episode."""
    return segments.join(repeated_phrases(segments, times, length).select("episode_id", "text"), ["episode_id", "text"], "left_anti").select(segments.columns)


def starting_with(segments: DataFrame, prefixes: list[str]) -> DataFrame:
    """Segments whose text starts with any of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("text").startswith(p)
    return segments.where(hit)


def quality_gate(segments: DataFrame, least: int = 100, longest: int = 500, times: int = 20, length: int = 20) -> DataFrame:
    """episode_id, segments, long_segments, most_repeats, verdict (too_few, repeats, pass) of each episode."""
    counted = segments.withColumn("_n", F.count_if(F.length("text") > length).over(W.partitionBy("episode_id", phrase_key(F.col("text")))))
    out = counted.groupBy("episode_id").agg(
        F.count("*").alias("segments"),
        F.count_if(F.length("text") > longest).alias("long_segments"),
        F.max("_n").alias("most_repeats"),
    )
    return out.withColumn("verdict", F.when(F.col("segments") < least, "too_few").when(F.col("most_repeats") > times, "repeats").otherwise("pass"))


def guest_start(segments: DataFrame, guests: DataFrame, late_ms: int = 3_000_000, song_ms: int = 180_000, gap_ms: int = 60_000, fallback_ms: int = 3_600_000) -> DataFrame:
    """episode_id, guest_start_ms: where the guest's part starts, for episodes with guests and late segments.

    After the last song break, the first segment that names a guest, else the
    first of all; without a break, the first late one that names a guest, else
    the fallback.
    """
    names = guests.groupBy("episode_id").agg(F.collect_set(F.lower("guest_name")).alias("_names"))
    late = segments.where(F.col("start_ms") >= late_ms).withColumn("_before", F.lag("end_ms").over(_in_order()))
    song = F.when(F.col("end_ms") - F.col("start_ms") >= song_ms, F.col("end_ms"))
    gap = F.when(F.col("start_ms") - F.col("_before") >= gap_ms, F.col("_before"))
    late = late.join(names, "episode_id").withColumn("_break", F.max(F.greatest(song, gap)).over(_episode()))
    named = F.exists("_names", lambda n: F.lower("text").contains(n))
    after = F.col("start_ms") >= F.col("_break")
    first = lambda cond: F.min_by("start_ms", F.when(cond, F.col("seq")))
    picked = late.groupBy("episode_id").agg(
        F.min_by("start_ms", F.when(after & named, F.col("seq"))).alias("a"),
        first(after).alias("b"),
        first(named).alias("c"),
        F.count_if(after & named).alias("na"),
        F.count_if(after).alias("nb"),
        F.count_if(named).alias("nc"),
    )
    return picked.select("episode_id", F.when(F.col("na") > 0, F.col("a")).when(F.col("nb") > 0, F.col("b")).when(F.col("nc") > 0, F.col("c")).otherwise(F.lit(fallback_ms)).cast("long").alias("guest_start_ms"))


def guest_starts_to_set(detected: DataFrame, episodes: DataFrame, shortest_ms: int = 3_000_000, force: bool = False) -> DataFrame:
    """Detected starts that may be stored: long enough episodes, not set yet (unless force), not beyond the end."""
    both = detected.join(episodes.select(F.col("id").alias("episode_id"), "duration_ms", F.col("guest_start_ms").alias("_set")), "episode_id")
    known = F.coalesce(F.col("duration_ms"), F.lit(0)) != 0
    ok = (~known | (F.col("duration_ms") >= shortest_ms)) & (F.lit(force) | F.col("_set").isNull()) & ~(known & (F.col("guest_start_ms") > F.col("duration_ms")))
    return both.where(ok).select("episode_id", "guest_start_ms")
