"""Plug-ins for external models, each a function from DataFrame to DataFrame, with deterministic offline stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeflow.functions import formats as X
from scribeflow.functions import text as T
from scribeflow.operators import vectors, windows


def embed(chunks: DataFrame, width: int = 64) -> DataFrame:
    """chunks with values: signed counts of hashed words, in place of an embedding model."""
    return chunks.withColumn("values", vectors.hashed_embedding(F.col("text"), width))


def all_verified(asked: DataFrame) -> DataFrame:
    """Every question answered with yes."""
    return asked.select(*[c for c in asked.columns if c != "context"], F.lit(True).alias("verdict"))


def verifier(call, columns: list[str], at_once: int = 8):
    """A check for entities.verified from a function of columns: a boolean for each row, null where the call failed."""
    from scribeflow.operators import calls

    def verify(asked: DataFrame) -> DataFrame:
        ends = calls.settled(asked, call, columns, "boolean", at_once)
        return ends.select(*[c for c in asked.columns if c != "context"], F.col("value").alias("verdict"))

    return verify


def audio_addresses(base: str, ending: str = ".m4a"):
    """Addresses of recordings below a public one: the audio service of ingest."""

    def addresses(asked: DataFrame) -> DataFrame:
        return asked.select("episode_id", F.concat(F.lit(base.rstrip("/") + "/"), T.percent_encoded(F.concat("episode_id", F.lit(ending)))).alias("audio_file"))

    return addresses


def named_places(names: tuple[str, ...]):
    """A place extractor for offline use: replies with the names, of a fixed list, that a sample holds."""

    def find(asked: DataFrame) -> DataFrame:
        held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower("sample"), F.lower(n)))
        return asked.select("episode_id", F.to_json(held).alias("raw_response"))

    return find


def named_guests(segments: DataFrame, known: DataFrame) -> DataFrame:
    """A guest extractor for offline use: episode_id, guest_name of the known names (guest_name) that segments mention."""
    from scribeflow.operators import entities

    return entities.mentions(known.select("guest_name"), segments, "guest_name").select("episode_id", "guest_name").distinct()


def gazetteer(known: DataFrame):
    """A lookup for the geocoding cascade, from a table (query, lat, lng)."""

    def lookup(asked: DataFrame) -> DataFrame:
        return asked.join(known, "query").select("name", "step", "lat", "lng")

    return lookup


def summary_prompt(segments: DataFrame, episodes: DataFrame, instructions: str = "Summarise this broadcast.") -> DataFrame:
    """id, prompt: what a summary model is asked for each episode."""
    text = segments.groupBy(F.col("episode_id").alias("id")).agg(windows.joined_text(sep="\n").alias("_t"))
    rows = episodes.join(text, "id")
    return rows.select("id", F.concat(F.lit(instructions + "\nDate: "), F.coalesce(X.long_date(F.col("published_at")), F.lit("unknown")), F.lit("\n\n"), "_t").alias("prompt"))


def applied_summaries(episodes: DataFrame, replies: DataFrame) -> DataFrame:
    """episodes (id, title, summary) with the parsed replies (id, reply): the title only if the reply has one."""
    from scribeflow.operators import tables

    row: Column = T.summary_reply(F.col("reply"))
    parsed = replies.select("id", row.alias("r")).select("id", "r.title", "r.summary")
    return tables.patch(episodes, parsed, "id", ("title",))
