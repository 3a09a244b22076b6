"""From raw documents to token ids: each stage applies one operator to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.llm import bpe, decontaminate, neardup, pii, sieve, toxicity
from scribeflow.runtime import Scratch, bounded_batches, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays (five words, similarity 0.8).

    Rows that repeat an id are one document, of which the row with the smallest text stays (nulls first, then the
    smallest of the other columns); rows without an id all stay. Which rows go is decided on ids alone: of the
    texts, only those whose id may be gone or repeated are shuffled.
    """
    gone = written(neardup.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    maybe, rest = sieve.parted(docs, F.col("doc_id").cast("long"), gone)
    rows = rest.unionByName(maybe.join(gone, "doc_id", "left_anti").select(docs.columns))
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rows
    maybe, single = sieve.parted(rows, F.col("doc_id").cast("long"), again)
    sortable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(*sorted(sortable, key=lambda c: c != "text"))
    one = maybe.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
    return single.unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows the text."""
    out = pii.redacted(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the token ids."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: Trained classifiers and minwise sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Scratch(spark)
        docs = kept.written(stage(spark, docs, sf_dir), name)
        if before:  # the next stage's input is written
            before.clear()
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
