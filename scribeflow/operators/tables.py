"""Writes as functions from tables to tables: insert-or-ignore, patch, delete, replace, rename, rescale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.operators import vectors, windows


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the rows of new whose keys it hasn't; of equal new keys one row."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti").select(stored.columns))


def patch(stored: DataFrame, changes: DataFrame, key: str, only_if_present: tuple[str, ...] = ()) -> DataFrame:
    """stored with the columns of changes set where the key is found; in only_if_present null and '' change nothing."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = stored.join(renamed, key, "left")
    out = []
    for c in stored.columns:
        if c not in columns:
            out.append(F.col(c))
        elif c in only_if_present:
            out.append(F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(out)


def delete_by(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(keys), keys, "left_anti").select(stored.columns)


def replace_by_key(stored: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """stored without the keys of touched (else of new), and new."""
    return stored.join((touched if touched is not None else new).select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(new.select(stored.columns))


def rename_values(links: DataFrame, renames: DataFrame, deletes: DataFrame, column: str) -> DataFrame:
    """links with the values of column renamed (old, new) or deleted (old); links that meet are one."""
    kept = links.join(deletes.select(F.col("old").alias(column)), column, "left_anti")
    both = kept.join(renames.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return both.withColumn(column, F.coalesce("_new", column)).select(links.columns).distinct()


def rescaled(segments: DataFrame, by: int = 10) -> DataFrame:
    """Times divided by a factor, in both ways in use: rounded half up (files) and truncated (tables)."""
    return segments.withColumns({f"{c}_rounded": F.floor(F.col(c) / by + 0.5) for c in ("start_ms", "end_ms")} | {f"{c}_cut": F.call_function("div", F.col(c), F.lit(by)) for c in ("start_ms", "end_ms")})


def repaired_times(segments: DataFrame, chunks: DataFrame, episodes: DataFrame, embed: Callable[[DataFrame], DataFrame], by: int = 10) -> tuple[DataFrame, DataFrame]:
    """segments and chunks (id, episode_id, ..., values) after the times of some episodes (episode_id) were divided by a factor.

    Their chunks go, new ones are cut from the rescaled segments, embedded and put in their place; of chunks with one
    id the last stays. All else is as it was.
    """
    ids = episodes.select("episode_id").distinct()
    cut = segments.join(ids, "episode_id", "left_semi").withColumns({c: F.call_function("div", F.col(c), F.lit(by)) for c in ("start_ms", "end_ms")})
    rows = segments.join(ids, "episode_id", "left_anti").select(segments.columns).unionByName(cut.select(segments.columns))
    new = embed(windows.last_per_id(windows.time_windows(cut)))
    return rows, vectors.upsert(delete_by(chunks, ids, ["episode_id"]), new.select(chunks.columns))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among the done: how an interrupted batch goes on."""
    return rows.join(done.select(key), key, "left_anti")
