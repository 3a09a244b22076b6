"""Schemas of the data model, and views of the generic test tables in its roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.runtime import table

#: Schemas, in DDL.
EPISODES = "id string not null, title string not null, audio_file string, duration_ms long, published_at date, summary string, guests_reviewed int, guest_start_ms long"
SEGMENTS = "episode_id string not null, seq long not null, start_ms long not null, end_ms long not null, text string not null"
EPISODE_GUESTS = "episode_id string not null, guest_name string not null"
PLACES = "id long not null, name string not null, lat double not null, lng double not null"
PLACE_MENTIONS = "place_id long not null, episode_id string not null"
TRANSCRIPT = "episode_id string, title string, segments array<struct<start_ms: long, end_ms: long, text: string>>"
VECTOR = "id string not null, values array<float> not null, metadata struct<episode_id: string, title: string, start_ms: long, end_ms: long, text: string>"
CANDIDATE = "ord long, name string, normalized_name string, address string, lat double, lng double, source string, sources array<string>, category string, categories array<string>, meta map<string, string>"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, 40 s apart, 0 to 40 s long."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    seq = (F.col("p") + 1).cast("long")
    start = seq * 40_000
    return rows.select("episode_id", seq.alias("seq"), start.alias("start_ms"), (start + (F.col("episode_id") * 7 + seq * 13) % 11 * 4_000).alias("end_ms"), "text")


#: The same rows in SQL, as a common table expression.
SEGMENTS_SQL = """seg AS (
  SELECT doc_id AS episode_id, CAST(i AS BIGINT) AS seq, CAST(i * 40000 AS BIGINT) AS start_ms,
    CAST(i * 40000 + ((doc_id * 7 + i * 13) % 11) * 4000 AS BIGINT) AS end_ms, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine of ten documents as weekly episodes; some on the wrong day, without a summary, or reviewed."""
    docs = table(spark, sf_dir, "documents")
    lines = F.size(F.split("text", "\n"))
    # the last end: of the last two lines one may end later
    ends = F.transform(F.sequence(F.lit(1), lines), lambda s: s.cast("long") * 40_000 + (F.col("doc_id") * 7 + s * 13) % 11 * 4_000)
    day = F.date_add(F.lit("2014-01-02").cast("date"), (F.col("doc_id") * 7 + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)).cast("int"))
    summary = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "").otherwise(F.concat(F.lit("about "), "source"))
    return docs.where("doc_id % 10 <> 9 AND text IS NOT NULL").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("title"), F.array_max(ends).alias("duration_ms"), day.alias("published_at"),
        summary.alias("summary"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("guests_reviewed"),
    )


EPISODES_SQL = (
    SEGMENTS_SQL
    + """, ep AS (
  SELECT d.doc_id AS id, 'doc-' || d.doc_id AS title, m.dur AS duration_ms,
    DATE '2014-01-02' + CAST(7 * d.doc_id + CASE WHEN d.doc_id % 17 = 0 THEN 1 ELSE 0 END AS INT) AS published_at,
    CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 5 = 1 THEN '' ELSE 'about ' || source END AS summary,
    CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS guests_reviewed
  FROM documents d JOIN (SELECT episode_id, max(end_ms) AS dur FROM seg GROUP BY 1) m ON m.episode_id = d.doc_id WHERE d.doc_id % 10 <> 9)"""
)


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as guests of the episodes that their orders number."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("episode_id"), F.col("c_name").alias("guest_name")).distinct()


GUESTS_SQL = "guests AS (SELECT DISTINCT o_orderkey AS episode_id, c_name AS guest_name FROM orders JOIN customer ON o_custkey = c_custkey)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places, mentioned in the episodes that their orders number; every fourth part nowhere."""
    return table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(F.col("l_partkey").alias("place_id"), F.col("l_orderkey").alias("episode_id")).distinct()


MENTIONS_SQL = "pm AS (SELECT DISTINCT l_partkey AS place_id, l_orderkey AS episode_id FROM lineitem WHERE l_partkey % 4 <> 0)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and customers as three sources of candidate names, with endings and coordinates by residue."""
    def rows(name: str, key: str, text: str, category: str, base: int) -> DataFrame:
        k = F.col(key)
        ending = F.when(k % 4 == 0, " Inc").when(k % 4 == 1, " LLC.").when(k % 4 == 2, " SF").otherwise("")
        return table(spark, sf_dir, name).select(
            (k + base).alias("ord"), F.lit(name).alias("source"), F.concat(F.col(text), ending).alias("name"), F.col(category).cast("string").alias("category"),
            F.when(k % 3 != 0, (k % 90).cast("double")).alias("lat"), F.when(k % 5 != 0, (k % 180).cast("double")).alias("lng"),
        )

    return rows("part", "p_partkey", "p_name", "p_type", 0).unionByName(rows("supplier", "s_suppkey", "s_name", "s_nationkey", 10_000_000)).unionByName(rows("customer", "c_custkey", "c_name", "c_mktsegment", 20_000_000))


def _candidate_sql(name: str, key: str, text: str, category: str, base: int) -> str:
    return f"""SELECT {key} + {base} AS ord, '{name}' AS source, {text} || CASE {key} % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' LLC.' WHEN 2 THEN ' SF' ELSE '' END AS name,
    CAST({category} AS VARCHAR) AS category, CASE WHEN {key} % 3 <> 0 THEN CAST({key} % 90 AS DOUBLE) END AS lat, CASE WHEN {key} % 5 <> 0 THEN CAST({key} % 180 AS DOUBLE) END AS lng FROM {name}"""


CANDIDATES_SQL = "cand AS (" + " UNION ALL ".join(
    [_candidate_sql("part", "p_partkey", "p_name", "p_type", 0), _candidate_sql("supplier", "s_suppkey", "s_name", "s_nationkey", 10_000_000), _candidate_sql("customer", "c_custkey", "c_name", "c_mktsegment", 20_000_000)]
) + ")"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("seq"), (F.col("turn") * 10_000).alias("start_ms"), (F.col("turn") * 10_000 + 8_000).alias("end_ms"), "text"
    )


TURNS_SQL = "seg AS (SELECT conv_id AS episode_id, turn AS seq, turn * 10000 AS start_ms, turn * 10000 + 8000 AS end_ms, text FROM conversations)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of requests: key, at (seconds), event_id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id")
