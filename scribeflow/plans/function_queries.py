"""Registered queries: scalar functions over the columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeflow.functions import formats as X
from scribeflow.functions import names as N
from scribeflow.functions import text as T
from scribeflow.plans._register import registrar
from scribeflow.runtime import table

QUERIES, SQL, query = registrar()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '' WHEN o_orderkey * 1000 // 3600000 > 0 THEN (o_orderkey // 3600) || 'h ' || (o_orderkey % 3600 // 60) || 'm' ELSE (o_orderkey % 3600 // 60) || 'm' END AS hm,
CASE WHEN o_orderkey // 3600 > 0 THEN (o_orderkey // 3600) || ':' || lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') ELSE (o_orderkey // 60) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS clock,
CASE WHEN o_orderkey < 60 THEN o_orderkey || 's' WHEN o_orderkey < 3600 THEN printf('%.1f', round(o_orderkey / 60, 1)) || ' min' ELSE (o_orderkey // 3600) || 'h ' || CAST(floor(o_orderkey % 3600 / 60 + 0.5) AS BIGINT) || 'm' END AS elapsed,
printf('%.1f', round(o_orderkey * 100000 / 1048576.0, 1)) || ' MB' AS mb FROM orders""")
def sf27_durations(spark, d):
    """SF27, SF30: durations and sizes as text."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", X.hours_minutes(k * 1000).alias("hm"), X.clock(k * 1000).alias("clock"), X.elapsed(k).alias("elapsed"), X.megabytes(k * 100_000).alias("mb"))


@query("""WITH g AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
SELECT id, CASE len(l) WHEN 1 THEN 'g' || l[1] WHEN 2 THEN 'g' || l[1] || ' & g' || l[2] WHEN 3 THEN 'g' || l[1] || ', g' || l[2] || ' & g' || l[3] ELSE 'g' || l[1] || ', g' || l[2] || ' & ' || (len(l) - 2) || ' others' END AS label,
len(l) || CASE WHEN len(l) = 1 THEN ' place mentioned like g' || l[1] WHEN len(l) = 2 THEN ' places mentioned like g' || l[1] || ' and g' || l[2] ELSE ' places mentioned like g' || l[1] || ', g' || l[2] || ', and g' || l[3] END || '.' AS places FROM g""")
def sf28_labels(spark, d):
    """SF28, SF29, SL08: labels of guests and places."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("g"), k)).alias("l"))
    return per.select("id", X.guest_label(F.col("l")).alias("label"), X.places_label(F.col("l")).alias("places"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, substr(html, 1, 200) AS cut FROM pages""")
def sf36_escape(spark, d):
    """SF31, SF36: cuts and HTML escapes."""
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"), F.substring("html", 1, 200).alias("cut"))


@query("""SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%-I:%M %p') AS pacific FROM events""")
def sf23_pacific(spark, d):
    """SF23, SF24: UTC instants on the Pacific wall clock."""
    return table(spark, d, "events").select("event_id", X.wall_clock(F.col("ts").cast("timestamp")).alias("pacific"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'bytes=' || s_suppkey || '-' || (s_suppkey * 2) WHEN s_suppkey % 3 = 1 THEN 'bytes=' || s_suppkey || '-' ELSE 'none' END AS header,
CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS first, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 2 END AS last, s_suppkey % 2 = 0 AS valid, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE greatest(1, s_suppkey) END AS page FROM supplier""")
def sf40_requests(spark, d):
    """SF40, SF41, SF44, Q08: range headers, audio keys, page numbers."""
    k = F.col("s_suppkey")
    header = F.when(k % 3 == 0, F.concat(F.lit("bytes="), k, F.lit("-"), k * 2)).when(k % 3 == 1, F.concat(F.lit("bytes="), k, F.lit("-"))).otherwise("none")
    key = F.when(k % 2 == 0, F.concat(F.lit("ep-"), k, F.lit(".m4a"))).otherwise(F.concat(F.lit("../"), k, F.lit(".m4a")))
    page = F.when(k % 5 == 0, "abc").otherwise(k.cast("string"))
    r = X.byte_range(header)
    return table(spark, d, "supplier").select("s_suppkey", header.alias("header"), r["first"].alias("first"), r["last"].alias("last"), X.audio_key(key).alias("valid"), X.page_number(page).cast("long").alias("page"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ', city, ' || s_suppkey ELSE s_name || ', ' || s_suppkey END AS address, CASE WHEN s_suppkey % 3 = 0 THEN 'A' || s_suppkey ELSE NULL END AS first_street,
CASE WHEN s_suppkey % 3 = 0 THEN 'B st' END AS second_street, s_suppkey % 4 = 0 AS inside, CAST(floor(s_acctbal + 0.5) AS BIGINT) AS rounded FROM supplier""")
def sf42_addresses(spark, d):
    """SF42, SF43, SF45, PF15: addresses, crossings, bounds, rounding."""
    k = F.col("s_suppkey")
    place = F.when(k % 3 == 0, F.concat(F.lit("A"), k, F.lit(" & B st"))).otherwise(F.concat(F.lit("C"), k))
    two = T.intersection(place)
    lat = F.when(k % 4 == 0, 37.75).otherwise(36.0)
    return table(spark, d, "supplier").select(
        "s_suppkey", T.join_parts(F.col("s_name"), F.when(k % 2 == 0, "city").otherwise(""), k.cast("string")).alias("address"), two[0].alias("first_street"), two[1].alias("second_street"),
        X.in_box(lat, F.lit(-122.4)).alias("inside"), X.js_round(F.col("s_acctbal")).alias("rounded"),
    )


@query("""WITH c AS (SELECT c_custkey // 10 AS batch, c_custkey % 10 + 1 AS i, c_custkey % 7 = 0 AS absent, c_acctbal > 0 AS good FROM customer),
g AS (SELECT batch, unnest(range(1, 11)) AS i FROM (SELECT DISTINCT batch FROM c))
SELECT g.batch, string_agg(CASE WHEN good AND NOT absent THEN 'YES' ELSE 'NO' END, ',' ORDER BY g.i) AS verdicts, string_agg(CASE WHEN good AND NOT absent THEN 'REMOVE' ELSE 'KEEP' END, ',' ORDER BY g.i) AS keeps
FROM g LEFT JOIN c ON c.batch = g.batch AND c.i = g.i GROUP BY g.batch""")
def sf18_verdicts(spark, d):
    """SF18, SF19: replies to batches of ten customers, a line for each, some without one and some with two: absent ones take the default, the last of several counts."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    i, good = k % 10 + 1, F.col("c_acctbal") > 0

    def replies(yes: str, no: str):
        line = F.concat(i, F.lit(". "), F.when(good, yes).otherwise(no), F.lit(" - "), F.col("c_mktsegment"))
        other = F.when(k % 5 == 0, F.concat(i, F.lit(". "), F.when(good, no).otherwise(yes), F.lit("\n"))).otherwise("")
        own = F.when(k % 7 == 0, "noise").otherwise(F.concat(other, line))
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, own.alias("l")))), lambda r: r["l"]), "\n")

    per = c.groupBy(F.call_function("div", k, F.lit(10)).alias("batch")).agg(replies("yes", "No").alias("a"), replies("Remove", "keep").alias("b"))
    return per.select("batch", F.array_join(T.verdicts(F.col("a"), F.lit(10)), ",").alias("verdicts"), F.array_join(T.verdicts(F.col("b"), F.lit(10), "REMOVE", "KEEP", "KEEP"), ",").alias("keeps"))


@query("""SELECT p_partkey, round(6 + 22 * sqrt(p_size / 50), 6) AS radius, round(ln(p_size) / ln(50), 6) AS t, CAST(floor(((p_partkey * 7) % 360) / 45.0 + 0.5) AS INT) % 8 AS point,
round(cos(radians(p_size)) * sin(radians((p_partkey * 7) % 360)), 6) + 0.0 AS x, round(sin(radians(p_size)), 6) AS y, round(cos(radians(p_size)) * cos(radians((p_partkey * 7) % 360)), 6) + 0.0 AS z FROM part""")
def sf38_sky(spark, d):
    """SF37-SF39: sizes and directions of stars."""
    az = (F.col("p_partkey") * 7 % 360).cast("double")
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    v = X.sky_xyz(az, F.col("p_size"))
    return table(spark, d, "part").select(
        "p_partkey", F.round(X.circle_radius(F.col("p_size"), F.lit(50)), 6).alias("radius"), F.round(X.star_scale(F.col("p_size"), F.lit(50)), 6).alias("t"),
        (F.array_position(names, X.compass_point(az)) - 1).cast("int").alias("point"), *[(F.round(v[c], 6) + 0.0).alias(c) for c in "xyz"],
    )


@query("SELECT doc_id, regexp_full_match(text, '[\\x00-\\x7F]*', 's') AS ascii, length(text) >= 20 AS long, regexp_full_match(CAST(doc_id AS VARCHAR), '[0-9]+') AS numeric, abs(n_chars - 1000) > 500 AS far, length(source) AS n FROM documents")
def pf08_predicates(spark, d):
    """PF08-PF10, PF24: ASCII, length, digits, tolerance."""
    return table(spark, d, "documents").select("doc_id", T.is_ascii(F.col("text")).alias("ascii"), (F.length("text") >= 20).alias("long"), F.col("doc_id").cast("string").rlike("^[0-9]+$").alias("numeric"), (F.abs(F.col("n_chars") - 1000) > 500).alias("far"), F.length("source").cast("long").alias("n"))


@query("SELECT o_orderkey, regexp_extract('show_' || strftime(o_orderdate, '%Y-%m-%d') || '_07', '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date, 'a%20' || o_orderkey || '%26b' AS encoded FROM orders")
def sf21_id_dates(spark, d):
    """SF21, SF35: dates in ids; percent-encoded keys."""
    o = table(spark, d, "orders")
    rid = F.concat(F.lit("show_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_07"))
    return o.select("o_orderkey", X.id_date(rid).cast("string").alias("date"), T.percent_encoded(F.concat(F.lit("a "), "o_orderkey", F.lit("&b"))).alias("encoded"))


@query(r"""SELECT c_custkey, regexp_replace(c_name || ' & "co" (x)', '[''"*(){}\[\]:^~!@#$%&]', '', 'g') AS phrase, trim(regexp_replace('The ' || c_name, '(?i)^(the|a|an)\s+', '')) AS bare FROM customer""")
def sf07_phrase_names(spark, d):
    """SF07, SF08: names as phrases, and without articles."""
    return table(spark, d, "customer").select("c_custkey", T.phrase_query(F.concat("c_name", F.lit(' & "co" (x)'))).alias("phrase"), N.strip_articles(F.concat(F.lit("The "), "c_name")).alias("bare"))
