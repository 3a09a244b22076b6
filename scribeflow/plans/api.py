"""The queries that users run: search, timeline, episodes, calendar, guests, maps. Each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import formats as X
from scribeflow.functions import text as T
from scribeflow.operators import textindex, vectors
from scribeflow.runtime import cut_lineage

PAGE = 20


def _page(rows: DataFrame, page: int, size: int) -> DataFrame:
    return rows.offset((max(1, page) - 1) * size).limit(size)


def search(segments: DataFrame, episodes: DataFrame, query: str, page: int = 1, size: int = PAGE, index: textindex.Index | None = None) -> DataFrame:
    """Matching segments of a page of episodes (newest id first), with best_rank and has_more.

    The page is chosen on ids and ranks; only its own texts are fetched. With
    an index, nothing else is read of the segments; a stored one without
    tombstones gives the newest episodes first, and as soon as they fill the
    page, no older postings are read.

    has_more is true when the page is full, even if nothing follows.
    """
    known = episodes.select(F.col("id").alias("episode_id"), "title", "duration_ms", "summary")
    for hits in index.newest_pages(query) if index else [textindex.bm25(segments, query)]:
        hits = hits.select("episode_id", "seq", "rank")
        best = hits.groupBy("episode_id").agg(F.min("rank").alias("best_rank")).join(known.select("episode_id"), "episode_id", "left_semi")
        chosen = _page(best.orderBy(F.desc("episode_id")), page, size).withColumn("has_more", F.count("*").over(W.partitionBy()) == size)
        chosen = F.broadcast(cut_lineage(chosen))  # a page, made once
        if chosen.count() == size:
            break
    own = segments.select("episode_id", "seq", "start_ms", "end_ms", "text").join(chosen, "episode_id")
    rows = own.join(hits.select("episode_id", "seq").join(chosen.select("episode_id"), "episode_id", "left_semi"), ["episode_id", "seq"], "left_semi")
    rows = known.join(rows, "episode_id")
    return rows.select("episode_id", "title", "duration_ms", "summary", "seq", "start_ms", "end_ms", "text", "best_rank", "has_more").orderBy(F.desc("episode_id"), "start_ms")


def search_cards(results: DataFrame) -> DataFrame:
    """search results as one row an episode, matches nested in order."""
    return results.groupBy("episode_id", "title", "duration_ms", "summary", "has_more").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("matches")).orderBy(F.desc("episode_id"))


def semantic_search(index: DataFrame, episodes: DataFrame, query: list[float], k: int = PAGE) -> DataFrame:
    """The k nearest chunks (id, values, episode_id, title, start_ms, end_ms, text) with episode data where it is known."""
    hits = vectors.top_k(index, query, k)
    meta = episodes.select(F.col("id").alias("episode_id"), F.col("title").alias("_title"), "duration_ms", "summary")
    rows = meta.join(F.broadcast(hits), "episode_id", "right")  # k rows
    return rows.select("episode_id", T.falsy_or(F.col("_title"), F.col("title")).alias("title"), F.nullif(F.col("duration_ms"), F.lit(0)).alias("duration_ms"), F.nullif(F.col("summary"), F.lit("")).alias("summary"), "start_ms", "end_ms", "text", "score").orderBy(F.desc("episode_id"), "start_ms")


def timeline(segments: DataFrame, episodes: DataFrame, query: str, index: textindex.Index | None = None) -> DataFrame:
    """month, mentions, episodes of the months with a mention."""
    hits = (index.match(query) if index else textindex.match(segments, query)).groupBy("episode_id").agg(F.count("*").alias("n"))
    dated = episodes.select(F.col("id").alias("episode_id"), X.month(F.col("published_at")).alias("month"))
    return hits.join(dated, "episode_id").groupBy("month").agg(F.sum("n").alias("mentions"), F.count("*").alias("episodes"))


def timeline_range(timeline_rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """total_mentions, first_month, last_month: all mentions, and the span of all episodes."""
    span = episodes.agg(F.min(X.month(F.col("published_at"))).alias("first_month"), F.max(X.month(F.col("published_at"))).alias("last_month"))
    total = timeline_rows.agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_mentions"))
    return total.crossJoin(span)  # one row each


def episode_list(episodes: DataFrame) -> DataFrame:
    return episodes.select("id", "title", "duration_ms", "summary").orderBy("id")


def episode(episodes: DataFrame, episode_id) -> DataFrame:
    return episodes.where(F.col("id") == F.lit(episode_id))


def on_this_day(episodes: DataFrame, month_day: str | None = None) -> DataFrame:
    """Episodes of a day of the year (MM-DD), newest first; without one, of today where the show is made."""
    day = F.lit(month_day) if month_day else X.today_month_day()
    return episodes.where(X.month_day(F.col("published_at")) == day).select("id", "title", "published_at").orderBy(F.desc("id"))


def guest_list(links: DataFrame, episodes: DataFrame) -> DataFrame:
    """guest_name, n_episodes, episodes (ids, newest first), total (guests)."""
    rows = links.join(episodes.select(F.col("id").alias("episode_id")), "episode_id")
    out = cut_lineage(rows.groupBy("guest_name").agg(F.count("*").alias("n_episodes"), F.sort_array(F.collect_list("episode_id"), asc=False).alias("episodes")))
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("total")))).orderBy(F.lower("guest_name"), "guest_name")  # one row


def episode_cards(episodes: DataFrame, links: DataFrame, mentions: DataFrame) -> DataFrame:
    """Episodes with their guests (array) and the number of places they mention."""
    who = links.groupBy(F.col("episode_id").alias("id")).agg(F.sort_array(F.collect_list("guest_name")).alias("guests"))
    where = mentions.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("place_count"))
    none = F.array().cast("array<string>")
    return episodes.select("id", "title").join(who, "id", "left").join(where, "id", "left").select("id", "title", F.coalesce("guests", none).alias("guests"), F.coalesce("place_count", F.lit(0)).alias("place_count"))


def map_places(places: DataFrame, mentions: DataFrame) -> DataFrame:
    """Places with episode_count, episodes (array) and the circle's radius, of those mentioned at all."""
    per = mentions.groupBy("place_id").agg(F.count("*").alias("episode_count"), F.sort_array(F.collect_list("episode_id")).alias("episodes"))
    rows = places.join(per, places["id"] == per["place_id"]).drop("place_id")
    top = per.agg(F.max("episode_count").alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("radius", X.circle_radius(F.col("episode_count"), F.col("_top"))).drop("_top")  # one row


def episode_places(places: DataFrame, mentions: DataFrame, episode_id) -> DataFrame:
    return mentions.where(F.col("episode_id") == F.lit(episode_id)).join(places, F.col("place_id") == F.col("id")).select("id", "name")


def unreviewed(episodes: DataFrame) -> DataFrame:
    return episodes.where("guests_reviewed = 0").select("id", "title").orderBy("id")
