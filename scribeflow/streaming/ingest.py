"""Ingest of transcripts as they arrive: events, admission once a key, stages, incremental index.

A micro-batch is written table by table under keys that make a rerun replace
its own rows, so a batch that fails half-way can simply run again. What was
admitted is in a table by key, of which a batch reads the buckets of its own
ids alone; so neither state nor a batch's cost grows with what came before. The text
index takes each batch as a segment, and merges them by size.

An episode that can't be processed costs no other: where a stage fails, halves
of the batch are tried until the episodes that fail are known; they end as
failed, with their error, and the rest goes through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scribeflow import ext
from scribeflow.functions import text as T
from scribeflow.operators import clean, entities, textindex, windows
from scribeflow.operators.indexlog import StoredIndex
from scribeflow.operators.keyed import KeyedTable
from scribeflow.runtime import written
from scribeflow.sources.listings import audio_events
from scribeflow.sources.transcripts import segments_of, stream_transcripts

@dataclass(frozen=True)
class Services:
    """External models and addresses, each a function between DataFrames; a stage without its service is passed over.

    embed: chunks to chunks with values; summarise: (id, prompt) to (id, reply); find_places: (episode_id, sample) to
    (episode_id, raw_response); audio: (episode_id) to (episode_id, audio_file).
    """

    embed: Callable[[DataFrame], DataFrame] | None = ext.embed
    summarise: Callable[[DataFrame], DataFrame] | None = None
    find_places: Callable[[DataFrame], DataFrame] | None = None
    audio: Callable[[DataFrame], DataFrame] | None = None


#: Stages whose failure is recorded and passed over.
SOFT = ("chunks", "places")


def upload_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of audio upload events from files of JSON lines that land in a folder."""
    return audio_events(spark.readStream.format("text").load(folder))


def once_per_key(events: DataFrame, key: str = "key", within: str | None = None, time: str = "at") -> DataFrame:
    """The first event of each key: for ever, or within a delay, which bounds the state."""
    if within:
        return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def stages(transcripts: DataFrame, services: Services) -> dict[str, Callable[[], DataFrame]]:
    """What a batch of transcripts gives, in order: cleaned segments, chunks, summaries, places, audio addresses."""
    segments = clean.clean_segments(segments_of(transcripts))
    episodes = transcripts.select(F.col("episode_id").alias("id"), "title", F.lit(None).cast("date").alias("published_at"), F.lit(None).cast("string").alias("summary"))
    chunks = lambda: windows.last_per_id(windows.time_windows(segments))
    out = {"segments": lambda: segments}
    if services.embed:
        out["chunks"] = lambda: services.embed(chunks())
    if services.summarise:
        out["summaries"] = lambda: services.summarise(ext.summary_prompt(segments, episodes)).select("id", T.summary_reply(F.col("reply")).alias("r")).select("id", "r.*")
    if services.find_places:
        out["places"] = lambda: entities.places_by_episode(services.find_places(windows.sample_text(segments)))
    if services.audio:
        out["audio"] = lambda: services.audio(transcripts.select("episode_id"))
    return out


ADMITTED = "episode_id string, state string, batch long, error string"
#: Buckets of the table of admitted episodes; trials that look for episodes that fail, at most.
BUCKETS, TRIALS = 64, 100


def admitted(spark: SparkSession, folder: str) -> KeyedTable:
    """The table of what became of each episode: completed or failed, in which batch, and why."""
    try:
        return KeyedTable(spark, f"{folder}/admitted")
    except ValueError:
        return KeyedTable.create(spark.createDataFrame([], ADMITTED), f"{folder}/admitted", ["episode_id"], BUCKETS)


def failing(docs: DataFrame, attempt: Callable[[DataFrame], None], error: str, trials: int = TRIALS) -> DataFrame:
    """episode_id, error of the documents with which an attempt fails, found by trying halves of those that do.

    With more than trials tries, a part that failed as a whole counts as failed. Ids are split by their hash.
    """
    spark, found, waiting = docs.sparkSession, [], [(0, 0, error)]  # bits of the hash that are fixed, their value, what went wrong
    while waiting:
        bits, value, error = waiting.pop(0)
        part = docs.where(F.pmod(F.xxhash64("episode_id"), F.lit(1 << bits)) == value)
        if trials <= 0 or bits == 60 or part.select("episode_id").distinct().limit(2).count() < 2:
            found.append(part.select("episode_id", F.lit(error).alias("error")))
            continue
        for half in (value, value + (1 << bits)):
            own = docs.where(F.pmod(F.xxhash64("episode_id"), F.lit(1 << (bits + 1))) == half)
            if own.isEmpty():
                continue
            trials -= 1
            try:
                attempt(own)
            except Exception as e:
                waiting.append((bits + 1, half, str(e)[:500]))
    out = spark.createDataFrame([], "episode_id string, error string")
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def write_batch(folder: str, services: Services = Services(), soft: tuple[str, ...] = SOFT) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each stage's rows go to folder/<table>/batch=<id>, texts into the index.

    Of documents of one id the first goes on; those whose episode another batch
    has completed go no further (folder/documents: completed, failed or
    already_exists). Every (batch, stage) ends in folder/status with its state
    and error. A failed soft stage is passed over. Where another stage fails,
    the episodes that make it fail end as failed, and the batch runs without
    them; they are taken up when they come again. If no single episode fails by
    itself, the batch has failed and can run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("episode_id").agg(F.min(F.struct("title", "segments")).alias("d")).select("episode_id", "d.*")
        book = admitted(spark, folder)
        known = book.among(first.select("episode_id")).where((F.col("batch") != number) & (F.col("state") == "completed"))
        docs = first.join(known.select("episode_id", F.lit(True).alias("known")), "episode_id", "left").persist()
        try:
            fresh = docs.where("known IS NULL").drop("known")
            bad = spark.createDataFrame([], "episode_id string, error string")
            while True:
                good = fresh.join(bad, "episode_id", "left_anti")
                broken = _stages(spark, folder, number, good, services, soft)
                if broken is None or good.isEmpty():  # nothing is left: all that came has failed
                    break
                name, error = broken
                more = written(failing(good, lambda part, name=name: stages(part, services)[name]().write.format("noop").mode("overwrite").save(), error), "failing")
                if more.isEmpty():
                    raise RuntimeError(f"stage {name} of batch {number}: {error}")
                bad = bad.unionByName(more)
            states = good.select("episode_id", F.lit("completed").alias("state"), F.lit(None).cast("string").alias("error"))
            states = states.unionByName(bad.select("episode_id", F.lit("failed").alias("state"), "error"))
            twice = docs.where("known").select("episode_id", F.lit("already_exists").alias("state"), F.lit(None).cast("string").alias("error"))
            states.unionByName(twice).write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
            text_index(spark, folder).write(spark.read.parquet(f"{folder}/segments/batch={number}"))
            text_index(spark, folder).compact()
            book.upsert(states.withColumn("batch", F.lit(number).cast("long")))
        finally:
            docs.unpersist()

    return run


def _stages(spark: SparkSession, folder: str, number: int, docs: DataFrame, services: Services, soft: tuple[str, ...]) -> tuple[str, str] | None:
    """Writes every stage of docs; the stage that failed and its error, if one did that isn't soft."""
    for name, make in stages(docs, services).items():
        state, error = "completed", ""
        try:
            make().write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        except Exception as e:
            state, error = "failed", str(e)[:500]
        status = spark.createDataFrame([(number, name, state, error)], "batch long, stage string, state string, error string")
        status.coalesce(1).write.mode("overwrite").parquet(f"{folder}/status/batch={number}/stage={name}")
        if error and name not in soft:
            return name, error
    return None


def start(spark: SparkSession, landing: str, folder: str, checkpoint: str, services: Services = Services()) -> StreamingQuery:
    """Runs ingest on all that has landed, each document once, and stops."""
    return stream_transcripts(spark, landing).writeStream.foreachBatch(write_batch(folder, services)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_index(spark: SparkSession, folder: str) -> StoredIndex:
    """The stored index that ingest keeps up to date."""
    return StoredIndex(spark, f"{folder}/index")


def index(spark: SparkSession, folder: str) -> textindex.Index:
    """The text index of all episodes that ingest has completed."""
    return text_index(spark, folder).index()


def with_failures(statuses: DataFrame) -> DataFrame:
    """batch, state: failed if any stage failed."""
    return statuses.groupBy("batch").agg(F.when(F.count_if(F.col("state") == "failed") > 0, "failed").otherwise("completed").alias("state"))
