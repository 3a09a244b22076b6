"""Registered queries: writes, as functions from tables to tables; set operations; payloads; pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeflow import model as M
from scribeflow.functions import text as T
from scribeflow.operators import calls, entities, tables, vectors, windows
from scribeflow.operators.keyed import KeyedTable
from scribeflow.plans._register import registrar
from scribeflow.runtime import fresh_path, table
from scribeflow.sources import listings, objects, pages, speech
from scribeflow.streaming import joblog

QUERIES, SQL, query = registrar()

_STORED = "stored AS (SELECT p_name AS name, max(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), fresh AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_size < 30 GROUP BY 1)"


def _stored(spark, d):
    p = table(spark, d, "part")
    stored = p.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("id"))
    fresh = p.where("p_size < 30").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return stored, fresh


@query(f"WITH {_STORED} SELECT * FROM stored UNION ALL SELECT * FROM fresh WHERE name NOT IN (SELECT name FROM stored)")
def sk02_insert_ignore(spark, d):
    """SK01, SK02: new names are added, known ones stay."""
    return tables.insert_ignore(*_stored(spark, d), ["name"])


@query(f"WITH {M.EPISODES_SQL}, c AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'new ' || doc_id END AS title, 's' || n_chars AS summary FROM documents WHERE doc_id % 2 = 0) SELECT ep.id, coalesce(nullif(c.title, ''), ep.title) AS title, CASE WHEN c.id IS NULL THEN ep.summary ELSE c.summary END AS summary FROM ep LEFT JOIN c ON c.id = ep.id")
def sk03_patch(spark, d):
    """SK03: title only if present, summary always."""
    changes = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("new "), "doc_id")).alias("title"), F.concat(F.lit("s"), "n_chars").alias("summary"))
    return tables.patch(M.episodes(spark, d).select("id", "title", "summary"), changes, "id", ("title",))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def sk04_delete(spark, d):
    """SK04, SK07: rows deleted by a list of ids."""
    gone = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return tables.delete_by(table(spark, d, "part").select(F.col("p_partkey").alias("id")), gone, ["id"])


@query(f"WITH {M.GUESTS_SQL}, n AS (SELECT o_orderkey AS episode_id, 'guest ' || o_orderstatus AS guest_name FROM orders WHERE o_orderkey % 5 = 0) SELECT * FROM guests WHERE episode_id NOT IN (SELECT episode_id FROM n) UNION ALL SELECT * FROM n")
def sk05_replace_by_key(spark, d):
    """SK05: an episode's guests replaced as a whole."""
    new = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("episode_id"), F.concat(F.lit("guest "), "o_orderstatus").alias("guest_name"))
    return tables.replace_by_key(M.guests(spark, d), new, "episode_id")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 10000000, 7 FROM embeddings WHERE vec_id % 50 = 0")
def sk06_vector_upsert(spark, d):
    """SK06, VE05: rows with known ids are replaced, others added."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), "label")
    new = rows.where("id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(rows.where("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit(7).alias("label")))
    return vectors.upsert(rows, new)


@query(f"WITH {M.GUESTS_SQL} SELECT DISTINCT episode_id, CASE guest_name WHEN 'Customer#000000001' THEN 'Ada' WHEN 'Customer#000000002' THEN 'Ada' ELSE guest_name END AS guest_name FROM guests WHERE guest_name <> 'Customer#000000004'")
def sk10_rename(spark, d):
    """SK10, SC12: guests renamed, merged where they meet, or deleted."""
    renames = spark.createDataFrame([("Customer#000000001", "Ada"), ("Customer#000000002", "Ada")], "old string, new string")
    return tables.rename_values(M.guests(spark, d), renames, spark.createDataFrame([("Customer#000000004",)], "old string"), "guest_name")


@query("""WITH s AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings), u AS (SELECT id, CASE WHEN id % 3 = 0 THEN label + 100 ELSE label END AS label FROM s UNION ALL SELECT id + 10000000, 7 FROM s WHERE id % 50 = 0),
p AS (SELECT id, CASE WHEN id % 4 = 0 THEN -id ELSE label END AS label FROM u) SELECT id, label FROM p WHERE id % 7 <> 0 UNION ALL SELECT id, 1 FROM s WHERE id % 7 = 0 AND id % 2 = 0""")
def sk06_keyed_changes(spark, d):
    """SK02 to SK04, SK06, SK07: a stored table by key, after an upsert, a patch, a delete and an insert of what isn't there."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    i = F.col("id")
    stored = KeyedTable.create(rows, fresh_path(spark, "keyed"), ["id"], 32)
    stored.upsert(rows.where(i % 3 == 0).withColumn("label", F.col("label") + 100).unionByName(rows.where(i % 50 == 0).select((i + 10_000_000).alias("id"), F.lit(7).cast("long").alias("label"))))
    stored.patch(stored.rows().where(i % 4 == 0).select("id", (-i).alias("label")))
    stored.delete(stored.rows().where(i % 7 == 0).select("id"))
    stored.insert_ignore(rows.where(i % 2 == 0).withColumn("label", F.lit(1).cast("long")))
    return stored.rows()


@query(f"""WITH {M.GUESTS_SQL}, c AS (SELECT c_name AS old, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE NULL END AS new FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0)
SELECT DISTINCT episode_id, coalesce(new, guest_name) AS guest_name FROM guests LEFT JOIN c ON old = guest_name WHERE old IS NULL OR new IS NOT NULL""")
def sk10_keyed_rename(spark, d):
    """SK10: guests renamed in a stored table, merged where they meet, or deleted; the corrections are a table."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    stored = KeyedTable.create(M.guests(spark, d), fresh_path(spark, "keyed"), ["guest_name"], 32)
    stored.rename(c.where(k % 3 == 0).select(F.col("c_name").alias("old"), F.upper("c_mktsegment").alias("new")), c.where((k % 5 == 0) & (k % 3 != 0)).select(F.col("c_name").alias("old")), "guest_name")
    return stored.rows()


@query(f"WITH {M.SEGMENTS_SQL} SELECT episode_id, seq, CAST(floor((start_ms + 5) / 10 + 0.5) AS BIGINT) AS start_ms_rounded, (start_ms + 5) // 10 AS start_ms_cut, CAST(floor((end_ms + 7) / 10 + 0.5) AS BIGINT) AS end_ms_rounded, (end_ms + 7) // 10 AS end_ms_cut FROM seg")
def sk11_rescale(spark, d):
    """SK11, CL18, SF45: times divided by ten, rounded and cut."""
    s = M.segments(spark, d)
    return tables.rescaled(s.withColumns({"start_ms": F.col("start_ms") + 5, "end_ms": F.col("end_ms") + 7})).select("episode_id", "seq", "start_ms_rounded", "start_ms_cut", "end_ms_rounded", "end_ms_cut")


@query(f"WITH {M.CANDIDATES_SQL} SELECT source, count(*) AS n, count(*) FILTER (lat IS NULL OR lng IS NULL) AS dropped FROM cand GROUP BY 1")
def pf17_missing_coordinates(spark, d):
    """PF17, SC10: candidates of each source, and those without coordinates."""
    rows = M.candidates(spark, d)
    whole = rows.dropna(subset=["lat", "lng"]).groupBy("source").agg(F.count("*").alias("k"))
    return rows.groupBy("source").agg(F.count("*").alias("n")).join(whole, "source", "left").select("source", "n", (F.col("n") - F.coalesce("k", F.lit(0))).alias("dropped"))


@query("SELECT p_name AS name, 'part' AS source, NULL AS category FROM part UNION ALL SELECT s_name, 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier")
def so01_bag_union(spark, d):
    """SO01, SC10: all rows of sources with different columns."""
    a = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("part").alias("source"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("source"), F.col("s_nationkey").cast("string").alias("category"))
    return entities.candidate_union(a, b)


@query("SELECT conv_id AS episode_id, turn + 1 AS seq, CAST(floor((turn * 1.25) * 1000 + 0.5) AS BIGINT) + 600000 AS start_ms, CAST(floor((turn * 1.25 + 1) * 1000 + 0.5) AS BIGINT) + 600000 AS end_ms, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def sc15_speech_seconds(spark, d):
    """SC15: a speech reply with seconds, as segments with an offset."""
    turn = F.struct((F.col("turn") * 1.25).alias("start"), (F.col("turn") * 1.25 + 1).alias("end"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    replies = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(turn)).alias("segments"))).alias("reply"))
    return speech.from_seconds(replies, offset_ms=600_000)


@query("SELECT conv_id AS episode_id, turn * 100 AS start_ms, turn * 100 + 50 AS end_ms, trim(text) AS text FROM conversations WHERE length(trim(text)) >= 3 AND regexp_full_match(trim(text), '[\\x00-\\x7F]*', 's')")
def sc15_speech_offsets(spark, d):
    """SC15: a local speech reply with millisecond offsets; text that isn't ASCII or is short goes."""
    turn = F.struct(F.struct((F.col("turn") * 100).alias("from"), (F.col("turn") * 100 + 50).alias("to")).alias("offsets"), F.concat(F.lit(" "), "text").alias("text"))
    replies = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(F.to_json(F.struct(F.collect_list(turn).alias("transcription"))).alias("reply"))
    return speech.from_offsets(replies).drop("seq")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"[\\s\\S]{0,40}?</a>', 1)) AS target FROM pages")
def sc09_page_links(spark, d):
    """SC09: links scraped from pages by pattern."""
    return pages.scraped(table(spark, d, "pages"), r'href="/([^"]+)"[\s\S]{0,40}?</a>', ["target"]).select("page_id", "target")


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, DATE '2020-01-01' + CAST(page_id % 900 AS INT) || '' AS date, 'http://x/' || page_id || '.mp3' AS audio FROM pages""")
def sf34_broadcast_pages(spark, d):
    """SF34, SF35: date, audio address and last part of the address of broadcast pages."""
    p = table(spark, d, "pages")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 900).cast("int")), "yyyy-MM-dd")
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"datePublished": "'), day)).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<meta content="'), day, F.lit('T07:30"'))).otherwise(F.concat(F.lit('<time class="x" datetime="'), day, F.lit('"')))
    audio = F.concat(F.lit('<a data-audio-src="'), F.base64(F.concat(F.lit("http://x/"), "page_id", F.lit(".mp3")).cast("binary")), F.lit('">'))
    html = F.concat(F.coalesce("html", F.lit("")), head, audio)  # within pages as they are
    return p.select("page_id", T.basename(F.col("url")).alias("base"), T.page_date(html).alias("date"), T.audio_source(html).alias("audio"))


@query("WITH o AS (SELECT p_partkey AS key, (p_partkey % 40 + 1) * 7000000 AS size FROM part), r AS (SELECT key, size, unnest(range(0, size, 20971520)) AS first FROM o) SELECT key, first // 20971520 AS part, first, least(20971520, size - first) AS length FROM r")
def sc05_byte_ranges(spark, d):
    """SC05: the ranges of every part as an object of 7 to 280 MB."""
    key = F.col("p_partkey")
    return windows.byte_ranges(table(spark, d, "part").select(key.alias("key"), ((key % 40 + 1) * 7_000_000).alias("size")))


@query("SELECT 'uploads/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.MP3' ELSE '.wav' END AS key, o_orderkey AS size FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0")
def sc13_upload_events(spark, d):
    """SC13, ST01, PF18: upload events worth a job; those without a key or of other kinds are passed over."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    key = F.when(k % 4 != 0, F.concat(F.lit("uploads/"), k, F.when(k % 3 == 0, ".MP3").otherwise(".wav")))
    return listings.audio_events(o.select(F.to_json(F.struct(F.struct(key.alias("key"), k.alias("size")).alias("object"))).alias("value")))


@query(f"WITH {M.EPISODES_SQL}, r AS (SELECT id, CASE id % 3 WHEN 0 THEN 'T' || id ELSE NULL END AS title, CASE id % 3 WHEN 0 THEN 'S' || id WHEN 1 THEN 'plain ' || id ELSE '{{\"title\": bad' END AS summary, CASE id % 3 WHEN 0 THEN 'a,b' ELSE '' END AS guests FROM ep) SELECT * FROM r")
def cl19_summary_replies(spark, d):
    """CL19, SF33: replies of a summary model; what isn't JSON is the summary itself."""
    e = M.episodes(spark, d)
    i = F.col("id")
    good = F.concat(F.lit('```json\n{"title": "T'), i, F.lit('", "summary": "S'), i, F.lit('", "guests": ["a", "b"]}\n```'))
    reply = F.when(i % 3 == 0, good).when(i % 3 == 1, F.concat(F.lit("plain "), i)).otherwise('{"title": bad')
    row = T.summary_reply(reply)
    return e.select("id", row.alias("r")).select("id", "r.title", "r.summary", F.array_join("r.guests", ",").alias("guests"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, strlen(text) AS size, (strlen(text) + 999) // 1000 AS parts, sha256(text) AS whole FROM documents WHERE text <> ''")
def sc05_object_chunks(spark, d):
    """SC05, SK09: texts put as objects, and read back by ranges of 1,000 bytes; joined they are the object."""
    folder = fresh_path(spark, "objects")
    made = objects.put(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body")), folder)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("bytes").alias("h")))), lambda r: r["h"])
    per = objects.chunks(made, folder, 1000).groupBy("key").agg(F.sum("length").alias("size"), F.count("*").alias("parts"), F.unhex(F.array_join(pieces, "")).alias("b"))
    return per.select("key", "size", "parts", F.sha2("b", 256).alias("whole"))


@query("""WITH o AS (SELECT doc_id, 'a' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.wav' ELSE '.m4a' END AS key, sha256(text) AS body FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id AS id, key, body, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS known, CASE doc_id % 4 WHEN 0 THEN doc_id % 60 WHEN 1 THEN 50 END AS first, CASE doc_id % 4 WHEN 0 THEN doc_id % 60 + 9 WHEN 1 THEN 63 END AS last FROM o)
SELECT id, CAST(CASE WHEN NOT known THEN 404 WHEN first IS NOT NULL THEN 206 ELSE 200 END AS INT) AS status, CASE WHEN known AND first IS NOT NULL THEN 'bytes ' || first || '-' || last || '/64' END AS content_range,
CASE WHEN known THEN CASE WHEN first IS NULL THEN body ELSE substr(body, CAST(first + 1 AS BIGINT), CAST(last - first + 1 AS BIGINT)) END END AS bytes FROM r""")
def q08_audio_ranges(spark, d):
    """Q08, SF40, SF41: requests for objects, whole or by range: status, place and bytes, of which no others are read."""
    folder, k = fresh_path(spark, "objects"), F.col("doc_id")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("a"), k, F.when(k % 11 == 0, ".wav").otherwise(".m4a")).alias("key"), F.sha2("text", 256).alias("body"))
    made = objects.put(rows.where(k % 7 != 0), folder)
    header = F.when(k % 4 == 0, F.concat(F.lit("bytes="), k % 60, F.lit("-"), k % 60 + 9)).when(k % 4 == 1, "bytes=50-").when(k % 4 == 2, "none")
    return objects.answers(rows.select(k.alias("id"), "key", header.alias("header")), made, folder).select("id", "status", "content_range", F.decode("bytes", "UTF-8").alias("bytes"))


@query("SELECT CAST(conv_id AS VARCHAR) AS job, turn + 1 AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i > 2")
def st06_replayed_lines(spark, d):
    """ST06, Q10: every conversation as the log of a job, written by its task; a late reader's lines from the third on."""
    folder = fresh_path(spark, "logs")
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("job")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: F.concat(r["turn"] + 1, F.lit("|"), r["text"])).alias("lines"))

    def keep(job, lines):
        log = joblog.LogWriter(folder, job)
        for text in lines:
            log.write(text)
        log.flush()
        return log.next

    calls.settled(turns, keep, ["job", "lines"], "bigint", at_once=4).agg(F.sum("value"), F.count("error")).collect()
    joblog.register(spark)
    rows = spark.read.format("job_logs").option("folder", folder).option("start", 2).load()
    at = F.instr("text", "|")
    return rows.select("job", F.substring("text", F.lit(1), at - 1).cast("long").alias("line"), F.substring("text", at + 1, F.length("text")).alias("text"))



@query("""WITH b AS (SELECT CAST(page_id AS VARCHAR) AS id, strftime(DATE '1992-01-01' + CAST(page_id * 11 % 2400 AS INT), '%Y-%m-%d') AS date FROM pages)
SELECT id, date FROM b WHERE date NOT IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderdate IS NOT NULL)""")
def jn18_broadcasts(spark, d):
    """JN18, SC09: broadcasts scraped from listing pages, link first or date first, on dates of which there is no recording."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    day = F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), (k * 11 % 2400).cast("int")), "yyyy-MM-dd")
    link, time = F.concat(F.lit('<a href="/broadcasts/'), k, F.lit('">on air</a>')), F.concat(F.lit('<time datetime="'), day, F.lit('T07:30">'))
    listing = F.concat(F.coalesce("html", F.lit("")), F.when(k % 2 == 0, F.concat(link, time)).otherwise(F.concat(time, link)))
    there = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).distinct()
    return pages.broadcasts(p.select("page_id", listing.alias("html"))).join(there, "date", "left_anti").select("id", "date")
