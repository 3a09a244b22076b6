"""Registered queries: cleaning, entities, catalogues, word statistics, streams as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeflow import ext
from scribeflow import model as M
from scribeflow.functions import formats as X
from scribeflow.functions import names as N
from scribeflow.functions import text as T
from scribeflow.operators import calls, catalog, clean, entities, lexicon, tables, windows
from scribeflow.plans._register import registrar
from scribeflow.runtime import cut_lineage, fresh_path, table
from scribeflow.sources import candidates as place_sources
from scribeflow.streaming import jobs, ratelimit

QUERIES, SQL, query = registrar()

SHOW = "Dawn Patrol Hour"
#: Cleaning thresholds that the small test tables reach.
LEAST, SHARE = 3, 0.02

_TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_KEY = f"lower({_TRIMMED})"
_SHORT = f"len(regexp_split_to_array({_TRIMMED}, '\\s+')) <= 3"
#: Some phrase of three to eight words four times in a row, in at least twelve words.
_LOOP = """(len(w) >= 12 AND len(list_filter(range(1, len(w) + 1), lambda i: len(list_filter([3, 4, 5, 6, 7, 8], lambda k:
  i + 4 * k - 1 <= len(w) AND w[i:i + 3 * k - 1] = w[i + k:i + 4 * k - 1])) > 0)) > 0)"""


def _sentences(spark, d):
    """Lines cut into pieces, with repeats, loops and empty spans: artefacts to clean."""
    rows = M.segments(spark, d)
    e, s = F.col("episode_id"), F.col("seq")
    text = F.when((e + s) % 11 == 0, F.lit("you know.")).when((e + s) % 13 == 0, F.concat_ws(" ", *[F.lit("so we went")] * 5)).when(s % 7 == 0, F.lit("A really  beard said it")).otherwise(F.col("text"))
    return rows.withColumn("text", text)


_SENTENCES = (
    M.SEGMENTS_SQL
    + """, sent AS (SELECT episode_id, seq, start_ms, end_ms, CASE WHEN (episode_id + seq) % 11 = 0 THEN 'you know.' WHEN (episode_id + seq) % 13 = 0 THEN 'so we went so we went so we went so we went so we went'
  WHEN seq % 7 = 0 THEN 'A really  beard said it' ELSE text END AS text FROM seg), s2 AS (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM sent)"""
)
_FIXED = "regexp_replace(text, '(?i)\\b(nearly|yearly|really|eerily|dearly)\\s+(bird|beard)\\b', 'Early Bird', 'g')"


@query(f"""WITH {_SENTENCES}, n AS (SELECT *, {_SHORT} AS short, sum(CASE WHEN {_SHORT} THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, {_KEY}) AS times, count(*) OVER (PARTITION BY episode_id) AS total FROM s2),
k AS (SELECT * FROM n WHERE start_ms <> end_ms AND NOT (short AND times > greatest({LEAST}, floor(total * {SHARE}))) AND NOT {_LOOP}),
l AS (SELECT *, lag(text) OVER (PARTITION BY episode_id ORDER BY seq) AS prev FROM k)
SELECT episode_id, seq, start_ms, end_ms, {_FIXED} AS text FROM l WHERE prev IS NULL OR prev <> text""")
def cl01_clean(spark, d):
    """CL01, SF04, SF05, AG10, WN01, PF07: the pipeline's cleaner."""
    return clean.clean_segments(_sentences(spark, d), least=LEAST, share=SHARE)


@query(f"""WITH {_SENTENCES}, c AS (SELECT * REPLACE (regexp_replace(text, '(?i)\\bwent\\b', 'walked', 'g') AS text) FROM s2), c2 AS (SELECT * REPLACE (regexp_split_to_array(lower(text), '\\s+') AS w) FROM c),
k AS (SELECT * FROM c2 WHERE start_ms <> end_ms AND NOT {_LOOP}), l AS (SELECT *, lag(text) OVER (PARTITION BY episode_id ORDER BY seq) AS prev FROM k),
m AS (SELECT * FROM l WHERE prev IS NULL OR prev <> text), n AS (SELECT *, {_SHORT} AS short, sum(CASE WHEN {_SHORT} THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, {_KEY}) AS times, count(*) OVER (PARTITION BY episode_id) AS total FROM m)
SELECT episode_id, seq, start_ms, end_ms, text FROM n WHERE NOT (short AND times > greatest({LEAST}, floor(total * {SHARE})))""")
def cl02_clean_scripts(spark, d):
    """CL02, SF03: the scripts' cleaner, with word corrections first and the count last."""
    return clean.clean_segments(_sentences(spark, d), "scripts", {"went": "walked"}, LEAST, SHARE)


@query(f"WITH {_SENTENCES}, b AS (SELECT episode_id, text FROM sent WHERE length(text) > 5 GROUP BY 1, 2 HAVING count(*) > 2) SELECT episode_id, seq, text FROM sent WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.episode_id = sent.episode_id AND b.text = sent.text)")
def cl03_purge(spark, d):
    """CL03, AG05, SK04: phrases that an episode repeats, removed after load."""
    return clean.purge_phrases(_sentences(spark, d), 2, 5).select("episode_id", "seq", "text")


@query(f"WITH {_SENTENCES} SELECT episode_id, text, count(*) AS cnt FROM sent WHERE length(text) > 5 GROUP BY 1, 2 HAVING count(*) > 2")
def ag05_having(spark, d):
    return clean.repeated_phrases(_sentences(spark, d), 2, 5)


@query(f"WITH {_SENTENCES}, b AS (SELECT count(*) AS c FROM sent WHERE length(text) > 5 GROUP BY episode_id, text HAVING count(*) > 2) SELECT CAST(sum(c) AS BIGINT) AS removed FROM b")
def ag26_removed_total(spark, d):
    return clean.repeated_phrases(_sentences(spark, d), 2, 5).agg(F.sum("cnt").alias("removed"))


@query(f"""WITH {_SENTENCES}, n AS (SELECT *, sum(CASE WHEN length(text) > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, {_KEY}) AS r FROM sent),
g AS (SELECT episode_id, count(*) AS segments, count(*) FILTER (length(text) > 500) AS long_segments, CAST(max(r) AS BIGINT) AS most_repeats FROM n GROUP BY 1)
SELECT *, CASE WHEN segments < 5 THEN 'too_few' WHEN most_repeats > 2 THEN 'repeats' ELSE 'pass' END AS verdict FROM g""")
def cl04_quality(spark, d):
    """CL04, AG11: the quality gate."""
    return clean.quality_gate(_sentences(spark, d), 5, 500, 2, 8)


@query(f"WITH {M.SEGMENTS_SQL} SELECT episode_id, seq FROM seg WHERE starts_with(text, 'The') OR starts_with(text, 'On')")
def pf04_prefixes(spark, d):
    return clean.starting_with(M.segments(spark, d), ["The", "On"]).select("episode_id", "seq")


def _guests_of(spark, d):
    return table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("episode_id"), F.when(F.col("doc_id") % 2 == 0, "THE ").otherwise("nd a").alias("guest_name"))


@query(f"""WITH {M.SEGMENTS_SQL}, g AS (SELECT doc_id AS episode_id, CASE WHEN doc_id % 2 = 0 THEN 'the ' ELSE 'nd a' END AS nm FROM documents WHERE doc_id % 3 <> 0),
late AS (SELECT seg.*, lag(end_ms) OVER (PARTITION BY seg.episode_id ORDER BY seq) AS prev, nm FROM seg JOIN g USING (episode_id) WHERE start_ms >= 80000),
b AS (SELECT *, max(greatest(CASE WHEN end_ms - start_ms >= 36000 THEN end_ms END, CASE WHEN start_ms - prev >= 30000 THEN prev END)) OVER (PARTITION BY episode_id) AS br FROM late)
SELECT episode_id, CAST(coalesce(arg_min(start_ms, seq) FILTER (start_ms >= br AND contains(lower(text), nm)), arg_min(start_ms, seq) FILTER (start_ms >= br), arg_min(start_ms, seq) FILTER (contains(lower(text), nm)), 3600000) AS BIGINT) AS guest_start_ms FROM b GROUP BY 1""")
def cl05_guest_start(spark, d):
    """CL05, WN02, WN09, WN10, JN17, PF21: where the guest's part starts."""
    return clean.guest_start(M.segments(spark, d), _guests_of(spark, d), 80_000, 36_000, 30_000)


# ---- entities

_NORM = r"lower(trim(regexp_replace(regexp_replace(trim(name), '(?i)(\s+(inc|llc|corp|co|ltd|lp|sf|san\s+francisco)\.?)+$', ''), '\s+', ' ', 'g')))"


def _flat(merged):
    return merged.withColumns({"sources": F.array_join("sources", ","), "categories": F.array_join("categories", ",")})


_MERGED = f"""{M.CANDIDATES_SQL}, n AS (SELECT *, {_NORM} AS normalized_name FROM cand),
f AS (SELECT normalized_name, arg_min(name, ord) AS name, arg_min(source, ord) AS source, arg_min(category, ord) AS category, min(ord) AS o, min(ord) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS w FROM n GROUP BY 1),
s AS (SELECT normalized_name, string_agg(source, ',' ORDER BY o) AS sources FROM (SELECT normalized_name, source, min(ord) AS o FROM n GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT normalized_name, string_agg(category, ',' ORDER BY o) AS categories FROM (SELECT normalized_name, category, min(ord) AS o FROM n GROUP BY 1, 2) GROUP BY 1),
merged AS (SELECT f.normalized_name, f.name, f.source, sources, f.category, categories, coalesce(b.lat, a.lat) AS lat, coalesce(b.lng, a.lng) AS lng
  FROM f JOIN s USING (normalized_name) JOIN c USING (normalized_name) JOIN cand a ON a.ord = o LEFT JOIN cand b ON b.ord = w)"""


@query(f"WITH {_MERGED} SELECT * FROM merged WHERE NOT (length(name) <= 2 OR regexp_full_match(name, '[0-9]+') OR lower(name) IN ({', '.join(repr(x) for x in N.PLACE_STOPLIST)}))")
def cl10_merge_candidates(spark, d):
    """CL10, AG13, SF09, SO01, SO04, PF09-PF11: three sources merged by normalised name and filtered."""
    return _flat(entities.usable_candidates(entities.merge_candidates(M.candidates(spark, d))))


@query(f"WITH {M.CANDIDATES_SQL} SELECT ord, {_NORM} AS normalized_name FROM cand")
def sf09_normalize(spark, d):
    return M.candidates(spark, d).select("ord", N.normalize_name(F.col("name")).alias("normalized_name"))


@query(f"WITH {M.CANDIDATES_SQL}, n AS (SELECT *, lower({_NORM}) AS k FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM n) SELECT ord, name FROM r WHERE r = 1")
def ag21_first_per_name(spark, d):
    return entities.first_per_name(M.candidates(spark, d), F.lower(N.normalize_name(F.col("name")))).select("ord", "name")


@query("WITH n AS (SELECT p_name AS n FROM part UNION SELECT p_name || ' set' FROM part WHERE p_partkey % 9 = 0) SELECT n AS normalized_name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE contains(b.n, a.n) AND b.n <> a.n)")
def jn24_longer_name_prune(spark, d):
    """JN24: names that stand inside a longer one go."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_name").alias("normalized_name")).union(p.where("p_partkey % 9 = 0").select(F.concat("p_name", F.lit(" set")))).distinct()
    return entities.longer_names_only(names)


def _mixed_guests(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.lower("c_name")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(k.alias("episode_id"), F.concat(F.substring(name, 1, 15), F.lit("x")).alias("guest_name"))


_MIXED = "g AS (SELECT c_custkey AS episode_id, substr(CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name) ELSE c_name END, 1, 15) || 'x' AS guest_name FROM customer)"


@query(f"WITH {_MIXED} SELECT min(guest_name) AS guest_name, count(*) AS n FROM g GROUP BY lower(guest_name)")
def ag08_nocase(spark, d):
    """AG08: guests whatever their case."""
    return entities.grouped_guests(_mixed_guests(spark, d))


def _similar_input(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.substring("s_name", 1, 5), F.lit(" "), F.reverse(F.substring("s_name", 14, 5)), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("e")).alias("guest_name")).distinct()


@query("""WITH g AS (SELECT DISTINCT substr(s_name, 1, 5) || ' ' || reverse(substr(s_name, 14, 5)) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'e' END AS n FROM supplier)
SELECT a.n AS a, b.n AS b, round(1 - levenshtein(lower(a.n), lower(b.n)) / greatest(length(a.n), length(b.n)), 6) AS sim FROM g a JOIN g b ON a.n < b.n WHERE 1 - levenshtein(lower(a.n), lower(b.n)) / greatest(length(a.n), length(b.n)) >= 0.85 - 1e-9""")
def jn11_similar_names(spark, d):
    """JN11, SF11, CL16: similar names, without comparing all with all."""
    return entities.similar_names(_similar_input(spark, d)).withColumn("sim", F.round("sim", 6))


def _names(spark, d):
    """Names of all suppliers, customers and parts, and the words that start the benchmark's texts, as candidate names."""
    own = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"))
    words = table(spark, d, "benchmark").select(F.explode(F.array(*[F.substring_index("text", " ", n) for n in (1, 2)])).alias("name"))
    return own("supplier", "s_name").union(own("customer", "c_name")).union(own("part", "p_name")).union(words).where("name <> ''").distinct()


_NAMES = """names AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part
  UNION (SELECT w FROM (SELECT unnest([string_split(text, ' ')[1], array_to_string(string_split(text, ' ')[1:2], ' ')]) AS w FROM benchmark) WHERE w <> '')),
nw AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^0-9a-z_]+'), lambda w: w <> '')[1] AS w FROM names),
sw AS (SELECT *, unnest(list_distinct(regexp_split_to_array(lower(text), '[^0-9a-z_]+'))) AS w FROM seg)"""


@query(f"WITH {M.SEGMENTS_SQL}, {_NAMES}, h AS (SELECT name, episode_id FROM nw JOIN sw USING (w) WHERE regexp_matches(text, '(?i)\\b' || regexp_escape(name) || '\\b') UNION ALL SELECT name, episode_id FROM nw JOIN seg ON w IS NULL AND regexp_matches(text, '(?i)\\b' || regexp_escape(name) || '\\b')) SELECT name, count(DISTINCT episode_id) AS episode_count, count(*) AS total_mentions FROM h GROUP BY 1")
def jn09_contains(spark, d):
    """JN09, CL12, AG16, SF10: candidate names in segments as whole words, found by one pass over the texts."""
    return entities.mention_counts(_names(spark, d), M.segments(spark, d))


@query(f"""WITH {M.SEGMENTS_SQL}, {_NAMES}, h AS (SELECT name, episode_id, seq, text FROM nw JOIN sw USING (w) WHERE regexp_matches(text, '(?i)\\b' || regexp_escape(name) || '\\b')
  UNION ALL SELECT name, episode_id, seq, text FROM nw JOIN seg ON w IS NULL AND regexp_matches(text, '(?i)\\b' || regexp_escape(name) || '\\b'))
SELECT names.name, x.context FROM names LEFT JOIN (SELECT name, arg_min(text, (episode_id, seq)) AS context FROM h GROUP BY 1) x ON x.name = names.name""")
def jn19_first_context(spark, d):
    """JN19, WN12: the first text that names a place, or none."""
    names = _names(spark, d).withColumn("id", F.col("name"))
    return entities.place_samples(names, M.segments(spark, d)).select("name", "context")


_TOKENS = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\pL\pN]+'), lambda t: t <> ''), ' ') || ' '"


_CORP = " OR ".join(f"ends_with(lower(name), '{s}')" for s in N.CORPORATE)


_CULTURE = "|".join(N.CULTURE_WORDS)


@query(f"""WITH {M.TURNS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY episode_id) AS n FROM seg),
w AS (SELECT DISTINCT x.episode_id, s AS first FROM x, LATERAL (SELECT unnest(list_concat(range(0, n - 5, 3), [n - 6])) AS s) WHERE n >= 6 AND p = 0),
v AS (SELECT w.episode_id, w.first, string_agg(text, ' ' ORDER BY seq) AS text FROM w JOIN x ON x.episode_id = w.episode_id AND p >= first AND p < first + 6 GROUP BY 1, 2),
t AS (SELECT episode_id, first, {_TOKENS} AS s FROM v), u AS (SELECT *, unnest(list_distinct(string_split(trim(s), ' '))) AS head FROM t),
c AS (SELECT string_split(lower(text), ' ') AS l FROM conversations), r AS (SELECT lower(p_name) AS name FROM part UNION SELECT l[1] FROM c UNION SELECT array_to_string(l[1:2], ' ') FROM c UNION SELECT array_to_string(l[1:4], ' ') FROM c),
ask AS (SELECT name, regexp_replace(name, '[''"*(){{}}\\[\\]:^~!@#$%&]', '', 'g') AS text FROM r WHERE length(trim(regexp_replace(name, '^(the|a|an)\\s+', ''))) >= 4 AND NOT ({_CORP}) AND name NOT IN ('of the') AND trim(regexp_replace(name, '^(the|a|an)\\s+', '')) NOT IN ('of the')),
k AS (SELECT name, {_TOKENS} AS q FROM ask), h AS (SELECT k.name, u.episode_id FROM k JOIN u ON u.head = string_split(trim(k.q), ' ')[1] AND contains(u.s, k.q) WHERE trim(k.q) <> ''),
g AS (SELECT name AS normalized_name, count(DISTINCT episode_id) AS episode_count, count(*) AS total_mentions FROM h GROUP BY 1)
SELECT *, CASE WHEN regexp_matches(normalized_name, '{_CULTURE}') THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE episode_count <= 50 OR (episode_count <= 100 AND regexp_matches(normalized_name, '{_CULTURE}'))""")
def cl11_cross_reference(spark, d):
    """CL11, AG12, AG25, SF17, JN10: a registry (names of parts, and how turns of talk begin) against windows, with confidence."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("start_ms"), F.split(F.lower("text"), " ").alias("l"))
    heads = F.explode(F.array(*[F.array_join(F.slice("l", 1, n), " ") for n in (1, 2, 4)]))
    registry = said.select(heads.alias("normalized_name"), "start_ms", F.concat(F.lit("turn "), "start_ms").alias("address"))
    parts = table(spark, d, "part").select(F.lower("p_name").alias("normalized_name"), F.col("p_partkey").alias("start_ms"), F.col("p_type").alias("address"))
    registry = registry.unionByName(parts).withColumn("end_ms", F.col("start_ms") + 1)
    return entities.cross_reference(registry, M.turns(spark, d), ("of the",))


@query(f"""WITH {M.CANDIDATES_SQL}, b AS (SELECT *, trim(regexp_replace(name, '(?i)^(the|a|an)\\s+', '')) AS bare FROM cand)
SELECT CASE WHEN length(bare) < 4 THEN 'short' WHEN {_CORP} THEN 'corp' WHEN name IN ('red bolt', 'blue ring') OR bare IN ('red bolt', 'blue ring') THEN 'blocked' ELSE 'searched' END AS reason, count(*) AS n FROM b GROUP BY 1""")
def ag25_skip_reasons(spark, d):
    """AG25, PF12, PF14, SF08: why names aren't searched; the first rule counts."""
    reason = F.coalesce(N.skip_reason(F.col("name"), F.array(F.lit("red bolt"), F.lit("blue ring"))), F.lit("searched"))
    return M.candidates(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT p_name AS name, count(*) AS episodes, CASE WHEN count(*) > 100 THEN 'skip' WHEN regexp_matches(lower(p_name), '{'|'.join(N.CULTURE_WORDS)}') THEN 'high' WHEN count(*) > 50 THEN 'skip' ELSE 'medium' END AS confidence FROM part GROUP BY p_name")
def sf17_confidence(spark, d):
    """SF17, PF13: confidence by name and number of episodes."""
    per = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("episodes"))
    return per.withColumn("confidence", N.confidence(F.col("name"), F.col("episodes")))


@query(f"""WITH {M.MENTIONS_SQL}, c AS (SELECT place_id, count(episode_id) AS n FROM pm GROUP BY 1) SELECT p_partkey AS id, p_name AS name, coalesce(n, 0) AS ep_count,
CASE WHEN length(p_name) <= 2 THEN 'remove_short' WHEN lower(p_name) IN ('red bolt', 'small ring') THEN 'remove_stoplist' WHEN lower(p_name) IN ('blue bolt') THEN 'known' ELSE 'verify' END AS decision FROM part LEFT JOIN c ON place_id = p_partkey""")
def cl13_place_review(spark, d):
    """CL13, JN04, PF11: places with their counts (zeros kept) and what to do with them."""
    return entities.place_review(M.places(spark, d), M.place_mentions(spark, d), ("red bolt", "small ring"), ("blue bolt",))


@query("""WITH m AS (SELECT upper(p_name) AS name, CASE WHEN p_partkey % 3 = 0 THEN 1.5 END AS lat, CASE WHEN p_partkey % 2 = 0 THEN 2.5 END AS lng, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'street' END AS address, p_partkey AS k FROM part),
k AS (SELECT lower(s_name) AS n, max(s_suppkey) AS place_id FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN p_name ELSE s_name END AS s_name FROM supplier JOIN part ON p_partkey = s_suppkey) GROUP BY 1)
SELECT m.k, place_id, CASE WHEN place_id IS NOT NULL THEN 'link' WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 'insert' WHEN coalesce(address, '') <> '' THEN 'geocode' ELSE 'skip' END AS plan FROM m LEFT JOIN k ON k.n = lower(m.name) WHERE lower(m.name) NOT IN ('red bolt')""")
def cl14_seeding_plan(spark, d):
    """CL14, PF16, JN14, JN23: matches to link, insert, geocode or skip."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    matches = p.select(F.upper("p_name").alias("name"), F.when(k % 3 == 0, 1.5).alias("lat"), F.when(k % 2 == 0, 2.5).alias("lng"), F.when(k % 5 == 0, "").otherwise("street").alias("address"), k.alias("k"))
    s = table(spark, d, "supplier").join(p, F.col("s_suppkey") == k)  # of all suppliers, a third go by the name of a part
    places = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 1, F.col("p_name")).otherwise(F.col("s_name")).alias("name"))
    return entities.seeding_plan(matches, places, ("red bolt",)).select("k", "place_id", "plan")


@query("""WITH k AS (SELECT lower(p_name) AS n, max(p_partkey) AS place_id FROM part GROUP BY 1), m AS (SELECT upper(p_name) AS name, [p_partkey, p_partkey + 1] AS eps FROM part)
SELECT DISTINCT place_id, unnest(eps) AS episode_id FROM m JOIN k ON k.n = lower(m.name)""")
def jn14_links_by_name(spark, d):
    p = table(spark, d, "part")
    matches = p.select(F.upper("p_name").alias("name"), F.array(F.col("p_partkey"), F.col("p_partkey") + 1).alias("episodes"))
    return entities.links_by_name(matches, M.places(spark, d))


@query("SELECT trim(p_brand) AS name, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS episodes, count(*) AS links FROM (SELECT DISTINCT p_brand, p_size AS k FROM part) GROUP BY 1")
def ag15_places_by_episode(spark, d):
    """AG15, AG27, SF32: replies that are JSON arrays, as places with their episodes."""
    replies = table(spark, d, "part").select(F.col("p_size").alias("episode_id"), F.concat(F.lit('```json\n[" '), "p_brand", F.lit(' ", ""]\n```')).alias("raw_response"))
    out = entities.places_by_episode(replies)
    return out.select("name", F.array_join(F.transform("episodes", lambda e: e.cast("string")), ",").alias("episodes"), F.size("episodes").cast("long").alias("links"))


_CROSSING = "CASE WHEN s_suppkey % 2 = 0 THEN 'St ' || s_suppkey || ' & Av ' || s_suppkey ELSE 'Place ' || s_suppkey END"


@query(f"""WITH n AS (SELECT {_CROSSING} AS name, s_suppkey AS k FROM supplier)
SELECT name, CAST(CASE WHEN k % 5 = 0 THEN 37.75 WHEN k % 2 = 0 AND k % 5 = 1 THEN 37.76 WHEN k % 2 = 0 AND k % 5 = 2 THEN 37.77 END AS DOUBLE) AS lat,
CAST(CASE WHEN k % 5 = 0 OR k % 2 = 0 AND k % 5 IN (1, 2) THEN -122.4 END AS DOUBLE) AS lng FROM n""")
def cl15_geocode(spark, d):
    """CL15, SF43: the first query of the cascade that finds a place; hits far away don't count."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("St "), k, F.lit(" & Av "), k)).otherwise(F.concat(F.lit("Place "), k)).alias("name"))
    k = F.col("k")
    whole = F.concat("name", F.lit(" San Francisco CA"))
    known = rows.select(F.explode(F.array(
        F.struct(F.when(k % 5 == 0, whole).alias("query"), F.lit(37.75).alias("lat")),
        F.struct(F.when((k % 2 == 0) & (k % 5 < 2), F.concat(F.lit("St "), k, F.lit(" and Av "), k, F.lit(", San Francisco"))).alias("query"), F.lit(37.76).alias("lat")),
        F.struct(F.when((k % 2 == 0) & (k % 5 < 3), F.concat(F.lit("St "), k, F.lit(", San Francisco CA"))).alias("query"), F.lit(37.77).alias("lat")),
        F.struct(F.when(k % 5 == 4, F.concat("name", F.lit(" far"))).alias("query"), F.lit(10.0).alias("lat")),
    )).alias("g")).select("g.query", "g.lat", F.lit(-122.4).alias("lng")).where("query IS NOT NULL")
    return entities.geocode_cascade(rows.select("name"), ext.gazetteer(known))


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ' Main St, Town' WHEN s_suppkey % 3 = 1 THEN 'Main St' END AS address,
CASE WHEN s_suppkey % 4 < 3 THEN CAST(s_suppkey % 90 AS DOUBLE) END AS lat, CASE WHEN s_suppkey % 4 < 3 THEN CAST(s_suppkey % 180 AS DOUBLE) END AS lng, 'bar' AS category, CAST(s_suppkey AS VARCHAR) AS element FROM supplier""")
def sc08_spatial(spark, d):
    """SC08: elements of a spatial query as candidates: a node's place, a centre, or none; address from tags."""
    k = F.col("s_suppkey")
    tags = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("name").alias("k"), F.col("s_name").alias("v")), F.struct(F.lit("addr:housenumber").alias("k"), F.when(k % 3 == 0, k.cast("string")).alias("v")),
        F.struct(F.lit("addr:street").alias("k"), F.when(k % 3 < 2, "Main St").alias("v")), F.struct(F.lit("addr:city").alias("k"), F.when(k % 3 == 0, "Town").alias("v")),
    ), lambda x: x["v"].isNotNull()))
    lat, lon = (k % 90).cast("double"), (k % 180).cast("double")
    node = k % 4 == 0
    center = F.when((k % 4 == 1) | (k % 4 == 2), F.struct(lat.alias("lat"), lon.alias("lon")))
    element = F.struct(F.when(node, "node").otherwise("way").alias("type"), k.alias("id"), F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"), center.alias("center"), tags.alias("tags"))
    out = place_sources.spatial(table(spark, d, "supplier").select(F.lit("bar").alias("category"), F.to_json(element).alias("element")))
    return out.select("name", "address", "lat", "lng", "category", F.col("meta")["element_id"].alias("element"))


@query("""SELECT o_orderkey AS episode_id, o_custkey * 1000 AS guest_start_ms FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 4 = 0 OR (o_orderkey % 4 * 1000000 >= 2000000 AND o_custkey * 1000 <= o_orderkey % 4 * 1000000))""")
def pf25_guest_starts(spark, d):
    """PF25: detected starts that may be stored: not set yet, in episodes long enough, not beyond the end; a duration of 0 is unknown."""
    o = table(spark, d, "orders")
    found = o.select(F.col("o_orderkey").alias("episode_id"), (F.col("o_custkey") * 1000).alias("guest_start_ms"))
    eps = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 * 1_000_000).alias("duration_ms"), F.when(F.col("o_orderkey") % 3 == 0, 5).alias("guest_start_ms"))
    return clean.guest_starts_to_set(found, eps, 2_000_000)


@query(f"""WITH {M.SEGMENTS_SQL}, s2 AS (SELECT * REPLACE (CASE WHEN episode_id % 4 = 1 THEN start_ms // 10 ELSE start_ms END AS start_ms, CASE WHEN episode_id % 4 = 1 THEN end_ms // 10 ELSE end_ms END AS end_ms) FROM seg),
u AS (SELECT episode_id, max(end_ms) AS d FROM s2 GROUP BY 1), w AS (SELECT episode_id, unnest(range(0, d, 35000)) AS ws FROM u),
c AS (SELECT s.episode_id, CAST(ws // 35000 AS BIGINT) AS win, arg_min(start_ms, seq) AS start_ms, string_agg(text, ' ' ORDER BY seq) AS text FROM w JOIN s2 s ON s.episode_id = w.episode_id AND end_ms > ws AND start_ms < ws + 45000 GROUP BY 1, 2)
SELECT episode_id || ':' || start_ms AS id, max(win) AS "window", 64 AS width FROM c WHERE regexp_full_match(text, '[\\x00-\\x7F]*', 's') AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20 GROUP BY 1""")
def cl18_repaired_times(spark, d):
    """CL18: chunks after the times of a quarter of the episodes were divided by ten: old ones deleted, new ones cut and embedded."""
    s = M.segments(spark, d)
    chunks = ext.embed(windows.last_per_id(windows.time_windows(s)))
    wrong = table(spark, d, "documents").where("doc_id % 4 = 1").select(F.col("doc_id").alias("episode_id"))  # the feature: some episodes are repaired
    return tables.repaired_times(s, chunks, wrong, ext.embed)[1].select("id", "window", F.size(F.filter("values", lambda v: v.isNotNull())).alias("width"))


# ---- catalogues


def _files(spark, d):
    """Orders as recordings: several spellings, some on one date, some unknown."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    ymd, dash = F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy-MM-dd")
    name = (
        F.when(k % 8 == 0, F.concat(F.lit("dawn-patrol-hour_"), dash, F.lit("_07-30-00.mp3")))
        .when(k % 8 == 1, F.concat(F.lit("App Recording "), ymd, F.lit(" 0815.mp3")))
        .when(k % 8 == 2, F.concat(F.lit("Dawn Patrol Hour "), ymd, F.lit(" final.mp3")))
        .when(k % 8 == 3, F.concat(F.lit("Dawn Patrol Hour - "), dash, F.lit(" (1).mp3")))
        .when(k % 8 == 4, F.concat(F.lit("Podcast Dawn Patrol Hour "), ymd, F.lit(".MP3")))
        .when(k % 8 == 5, F.concat(F.lit("tape "), k, F.lit(".mp3")))
        .when(k % 8 == 6, F.concat(F.lit("rec_("), F.date_format(day, "MM_dd_yyyy"), F.lit(")_1.mp3")))
        .otherwise(F.concat(F.lit("notes "), k, F.lit(".txt")))
    )
    # a listing is made once: its names aren't recomputed in every rule that looks at them
    return cut_lineage(o.select(name.alias("filename"), (k % 11 * 1_000_000).alias("size"), F.to_date(day).alias("born")).distinct())


_FILES = """files AS (SELECT DISTINCT CASE o_orderkey % 8 WHEN 0 THEN 'dawn-patrol-hour_' || strftime(o_orderdate, '%Y-%m-%d') || '_07-30-00.mp3' WHEN 1 THEN 'App Recording ' || strftime(o_orderdate, '%Y%m%d') || ' 0815.mp3'
  WHEN 2 THEN 'Dawn Patrol Hour ' || strftime(o_orderdate, '%Y%m%d') || ' final.mp3' WHEN 3 THEN 'Dawn Patrol Hour - ' || strftime(o_orderdate, '%Y-%m-%d') || ' (1).mp3' WHEN 4 THEN 'Podcast Dawn Patrol Hour ' || strftime(o_orderdate, '%Y%m%d') || '.MP3'
  WHEN 5 THEN 'tape ' || o_orderkey || '.mp3' WHEN 6 THEN 'rec_(' || strftime(o_orderdate, '%m_%d_%Y') || ')_1.mp3' ELSE 'notes ' || o_orderkey || '.txt' END AS filename,
  o_orderkey % 11 * 1000000 AS size, CAST(o_orderdate AS DATE) AS born, o_orderkey % 8 AS kind FROM orders),
dated AS (SELECT *, CASE WHEN kind IN (5, 7) THEN NULL WHEN kind = 1 THEN 'dawn-patrol-hour_' || born || '_08-15-00' ELSE 'dawn-patrol-hour_' || born || '_07-30-00' END AS pid,
  CASE WHEN kind = 7 THEN NULL WHEN kind = 5 THEN regexp_replace(filename, '\\.mp3$', '') WHEN kind = 1 THEN 'dawn-patrol-hour_' || born || '_08-15-00' ELSE 'dawn-patrol-hour_' || born || '_07-30-00' END AS sid,
  CASE WHEN kind IN (5, 7) THEN NULL ELSE born END AS date FROM files)"""


@query(f"WITH {_FILES} SELECT filename, size, pid AS id FROM dated")
def sf20_parse_id_a(spark, d):
    """SF20 A, PF18: ids of recordings by the pipeline's rules."""
    return _files(spark, d).select("filename", "size", N.recording_id(F.col("filename"), SHOW).alias("id"))


@query(f"WITH {_FILES} SELECT filename, size, sid AS id FROM dated WHERE kind <> 7")
def sf20_parse_id_b(spark, d):
    """SF20 B: ids by the scripts' rules."""
    return _files(spark, d).where(F.lower("filename").endswith(".mp3")).select("filename", "size", N.recording_id(F.col("filename"), SHOW, "scripts").alias("id"))


@query(f"WITH {_FILES} SELECT filename, size, CASE WHEN contains(lower(filename), 'final') OR contains(lower(filename), '_full') THEN 100 ELSE 0 END + CASE WHEN contains(lower(filename), 'copy') OR regexp_matches(filename, '\\([0-9]+\\)') THEN -50 ELSE 0 END + CASE WHEN starts_with(lower(filename), 'podcast ') THEN -10 ELSE 0 END + CASE WHEN regexp_matches(filename, '(?i)\\s[0-9]\\.mp3$') THEN -20 ELSE 0 END AS score FROM files")
def sf15_preference(spark, d):
    return _files(spark, d).select("filename", "size", N.file_score(F.col("filename")).alias("score"))


_BEST = f"""{_FILES}, v AS (SELECT *, bool_or(size >= 5242880) OVER (PARTITION BY date) AS big, CASE WHEN kind = 2 THEN 100 WHEN kind = 3 THEN -50 WHEN kind = 4 THEN -10 ELSE 0 END AS score FROM dated WHERE date IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN big THEN score END DESC NULLS LAST, size DESC, score DESC, filename) AS r FROM v WHERE size >= 5242880 OR NOT big)"""


@query(f"WITH {_BEST} SELECT sid AS recording_id, CAST(date AS VARCHAR) AS date, filename, size FROM best WHERE r = 1 AND sid NOT IN (SELECT sid FROM dated WHERE sid IS NOT NULL AND size = 1000000)")
def cl06_discover(spark, d):
    """CL06, SC04, AG14, PF19, WN04, JN07: the best file of each date that isn't done yet."""
    files = _files(spark, d)
    done = catalog.dated_files(files, SHOW).where("size = 1000000").select("recording_id")
    return catalog.discover(files, done, SHOW).select("recording_id", F.col("date").cast("string").alias("date"), "filename", "size")


@query(f"WITH {_FILES} SELECT CAST(date AS VARCHAR) AS date, count(*) AS files FROM dated WHERE date IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def cl07_duplicate_dates(spark, d):
    return catalog.duplicate_dates(catalog.dated_files(_files(spark, d), SHOW)).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {M.EPISODES_SQL} SELECT CAST(published_at AS VARCHAR) AS date FROM ep WHERE dayofweek(published_at) <> 4 GROUP BY 1")
def cl07_off_days(spark, d):
    """CL07, SF25: episodes on another weekday."""
    return catalog.off_days(M.episodes(spark, d).select(F.col("published_at").alias("date"))).select(X.date_text(F.col("date")).alias("date"))


@query(f"WITH {M.EPISODES_SQL}, w AS (SELECT CAST(unnest(generate_series((SELECT min(published_at) + CAST((11 - dayofweek(min(published_at))) % 7 AS INT) FROM ep), (SELECT max(published_at) FROM ep), INTERVAL 7 DAY)) AS DATE) AS date) SELECT CAST(date AS VARCHAR) AS date FROM w WHERE date NOT IN (SELECT published_at FROM ep)")
def jn13_missing_weeks(spark, d):
    """JN13, CL07, SF25, SO03: Thursdays without an episode."""
    e = M.episodes(spark, d).select(F.col("published_at").alias("date"))
    return catalog.missing_weeks(e.where(F.dayofweek("date") == 5).union(e)).select(X.date_text(F.col("date")).alias("date"))


@query(f"""WITH {_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN kind = 1 THEN '00495' WHEN kind = 0 THEN '00450' ELSE regexp_replace(filename, '(?i)\\.mp3$', '') END, filename) AS i, count(*) OVER (PARTITION BY date) AS n FROM dated WHERE date IS NOT NULL),
p AS (SELECT filename AS src, 'Dawn Patrol Hour ' || date || CASE WHEN n > 1 THEN ' ' || i ELSE '' END || '.mp3' AS dest FROM k UNION ALL SELECT filename, regexp_replace(filename, '\\.mp3$', '') || ' Dawn Patrol Hour ' || born || '.mp3' FROM dated WHERE kind = 5),
c AS (SELECT *, count(*) OVER (PARTITION BY dest) AS m FROM p) SELECT src, dest, CASE WHEN m > 1 THEN 'collision' WHEN src = dest THEN 'same' ELSE 'rename' END AS status FROM c""")
def cl08_rename_plan(spark, d):
    """CL08, WN03, SF16, AG23, SL11, SK16: file names by date and time of day."""
    return catalog.rename_plan(_files(spark, d), SHOW)


def _listings(spark, d):
    o = table(spark, d, "orders")
    row = lambda tag: o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderkey").alias("k")).select("date", F.concat(F.lit(tag), "k").alias("recording_id"), F.concat(F.lit(tag + "-file"), "k").alias("file"))
    return row("a").where(F.dayofmonth("date") < 20), row("b").where(F.dayofmonth("date") > 10)


_LISTINGS = """o AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS k FROM orders GROUP BY 1), a AS (SELECT * FROM o WHERE day(date) < 20), b AS (SELECT * FROM o WHERE day(date) > 10)"""


@query(f"WITH {_LISTINGS} SELECT CAST(coalesce(b.date, a.date) AS VARCHAR) AS date, CASE WHEN b.k IS NOT NULL THEN 'b' || b.k ELSE 'a' || a.k END AS recording_id, CASE WHEN b.k IS NOT NULL THEN 'b-file' || b.k ELSE 'a-file' || a.k END AS file FROM a FULL JOIN b ON a.date = b.date")
def jn15_full_prefer_right(spark, d):
    """JN15: two listings by date, the right one wins."""
    return catalog.merged_listings(*_listings(spark, d)).withColumn("date", F.col("date").cast("string"))


def _manifest(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"))
    k = F.col("recording_id")
    return catalog.manifest(ids, ids.where(k % 2 == 0), ids.where(k % 3 == 0), ids.where(k % 5 == 0), ids.where(k % 7 == 0))


_MANIFEST = "m AS (SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'completed' ELSE 'pending' END AS status FROM orders)"


@query(f"WITH {_MANIFEST} SELECT * FROM m")
def jn16_status_cascade(spark, d):
    """JN16, CL09: the status of each recording; the first rule counts."""
    return _manifest(spark, d)


@query(f"WITH {_MANIFEST} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(count(*) FILTER (status = 'completed') * 100 / count(*), 1) AS percent FROM m")
def ag17_histogram(spark, d):
    """AG17, AG06: a count for each status, zeros kept."""
    return catalog.status_counts(_manifest(spark, d))


@query(f"WITH {_MANIFEST} SELECT recording_id FROM m WHERE NOT (status = 'failed' OR (status = 'skipped' AND recording_id % 2 = 1))")
def pf26_pruned_progress(spark, d):
    """PF26: what a retry forgets."""
    rows = _manifest(spark, d).withColumn("reason", F.when(F.col("recording_id") % 2 == 1, "Hallucination found").otherwise("short"))
    return catalog.pruned_progress(rows, "hallucination").select("recording_id")


@query("SELECT DISTINCT o_orderkey AS recording_id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def so02_finished_ids(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"))
    k = F.col("recording_id")
    return catalog.finished_ids(ids.where(k % 2 == 0), ids.where(k % 5 == 0), ids.where(k % 7 == 0))


@query("SELECT round(avg(o_totalprice) / 60 * 12, 4) AS minutes FROM orders")
def ag18_time_left(spark, d):
    """AG18: mean time so far, for what remains."""
    return catalog.time_left(table(spark, d, "orders").select(F.col("o_totalprice").alias("seconds")), 12).select(F.round("minutes", 4).alias("minutes"))


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def sl10_first_pending(spark, d):
    """SL10, PF20, JN07, JN18: the first 50 that aren't processed, from a date on."""
    done = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, d, "orders").where("o_orderdate >= '1995-01-01'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return tables.unprocessed(o, done, "o_orderkey").orderBy("day", "o_orderkey").limit(50).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_FILES} SELECT date IS NOT NULL AS parseable, count(*) AS files FROM dated WHERE kind <> 7 GROUP BY 1")
def so05_parseable(spark, d):
    """SO05: files with a date in their name, and without."""
    return catalog.dated_files(_files(spark, d), SHOW).groupBy(F.col("date").isNotNull().alias("parseable")).agg(F.count("*").alias("files"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'high' WHEN p_size < 20 THEN 'llm_verified' END AS confidence FROM part WHERE p_size < 20")
def pf23_confident(spark, d):
    """PF23: matches of high or verified confidence."""
    size = F.col("p_size")
    confidence = F.when(size < 10, "high").when(size < 20, "llm_verified").when(size < 30, "medium").otherwise("unverified")
    return table(spark, d, "part").select("p_partkey", confidence.alias("confidence")).where(F.col("confidence").isin("high", "llm_verified"))


# ---- word statistics

_STOP = ", ".join(repr(w) for w in lexicon.STOP_WORDS)
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({w}, ''), lambda c: CAST(unicode(c) AS BIGINT)){tail}), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_FNV1, _FNV2 = _FNV.format(w="word", tail=""), _FNV.format(w="word", tail="").replace("list_prepend(CAST(2166136261 AS BIGINT), ", "list_append(list_prepend(CAST(2166136261 AS BIGINT), ").replace("), lambda h, c: (xor", "), CAST(0 AS BIGINT)), lambda h, c: (xor", 1)
_WORDS = f"""{M.SEGMENTS_SQL}, w0 AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z''-]', ' ', 'g'), '\\s+')) AS w FROM seg), w1 AS (SELECT regexp_replace(w, '^[''-]+|[''-]+$', '', 'g') AS word FROM w0),
wc AS (SELECT word, count(*) AS count FROM w1 WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY 1)"""


@query(f"""WITH {_WORDS}, t AS (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS r FROM wc ORDER BY count DESC, word LIMIT 1500)
SELECT word, count, round(floor(CAST(({_FNV1} % 864000) AS DOUBLE) / 36000 * 1000 + 0.5) / 1000, 6) AS ra, round(floor((CAST(({_FNV2} % 18001) AS DOUBLE) / 100 - 90) * 100 + 0.5) / 100, 6) AS dec, r <= 500 AS labelled FROM t""")
def cl17_lexicon(spark, d):
    """CL17, SF12-SF14, AG09, SL03, WN13, Q14: the most frequent words and their places in the sky."""
    return lexicon.constellation(M.segments(spark, d)).withColumns({"ra": F.round("ra", 6), "dec": F.round("dec", 6)})


@query(f"WITH {_WORDS} SELECT word, count FROM wc")
def ag09_word_counts(spark, d):
    return lexicon.word_counts(M.segments(spark, d))


@query("SELECT upper(substr(s_name, length(s_name), 1)) AS letter, count(*) AS n FROM supplier GROUP BY 1")
def ag22_first_letters(spark, d):
    """AG22: names by a letter."""
    return table(spark, d, "supplier").groupBy(F.upper(F.substring("s_name", -1, 1)).alias("letter")).agg(F.count("*").alias("n"))


@query(f"WITH {M.GUESTS_SQL} SELECT DISTINCT episode_id FROM guests WHERE episode_id IN (SELECT doc_id FROM documents)")
def ag20_distinct(spark, d):
    """AG20, JN08: distinct ids that the database knows."""
    known = table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"))
    return M.guests(spark, d).select("episode_id").distinct().join(known, "episode_id", "left_semi")


# ---- streams, replayed as batches


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", event_id) AS i FROM e),
g AS (SELECT key, "at", event_id, i, ["at"] AS times, true AS admitted FROM r WHERE i = 1 UNION ALL
  SELECT r.key, r."at", r.event_id, r.i, CASE WHEN len(list_filter(g.times, lambda t: t > r."at" - 86400)) < 5 THEN list_append(list_filter(g.times, lambda t: t > r."at" - 86400), r."at") ELSE list_filter(g.times, lambda t: t > r."at" - 86400) END,
  len(list_filter(g.times, lambda t: t > r."at" - 86400)) < 5 FROM g JOIN r ON r.key = g.key AND r.i = g.i + 1)
SELECT key, "at", event_id, admitted FROM g""")
def st05_rate_limit(spark, d):
    """ST05: at most five requests a day for each key; rejected ones aren't recorded."""
    return ratelimit.admitted(M.requests(spark, d), limit=5, window_s=86_400)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id FROM events)
SELECT key, arg_min(event_id, ("at", event_id)) AS event_id, min("at") AS "at", count(*) AS events FROM e GROUP BY 1""")
def st02_dedupe(spark, d):
    """ST02: the first event of each key, and how many came."""
    return ratelimit.first_per_key(M.requests(spark, d))


_STEPS = ("transcribe", "seed-db", "embeddings", "summary", "extract-places", "set-audio-url")


def _step(k: int):
    def run(key, request, segments):
        if (request + k) % 11 == 0:
            raise ValueError(f"{_STEPS[k]} of {request}")
        return [{"text": key, "n": i} for i in range(request % 1200)]

    return jobs.Step(_STEPS[k], run, soft=_STEPS[k] == "extract-places")


_ENDS = 'r."at" + CASE WHEN r.fails THEN r.k + 1 ELSE 6 END * 10800000'
_AGAIN = 'g.fails AND g.ends <= r."at"'


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS "at", event_id AS id, (11 - event_id % 11) % 11 AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", id) AS i, k < 6 AND k <> 4 AS fails FROM e),
g AS (SELECT r.key, r.i, {_ENDS} AS ends, r.fails, r.k, r.id AS job, 1 AS starts, 0 AS refused FROM r WHERE r.i = 1 UNION ALL
  SELECT r.key, r.i, CASE WHEN {_AGAIN} THEN {_ENDS} ELSE g.ends END, CASE WHEN {_AGAIN} THEN r.fails ELSE g.fails END, CASE WHEN {_AGAIN} THEN r.k ELSE g.k END,
    CASE WHEN {_AGAIN} THEN r.id ELSE g.job END, g.starts + CASE WHEN {_AGAIN} THEN 1 ELSE 0 END, g.refused + CASE WHEN {_AGAIN} THEN 0 ELSE 1 END
  FROM g JOIN r ON r.key = g.key AND r.i = g.i + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS back FROM g)
SELECT key, CASE WHEN fails THEN 'failed' ELSE 'completed' END AS status, CASE WHEN fails THEN [{", ".join(f"'{s}'" for s in _STEPS)}][k + 1] ELSE 'set-audio-url' END AS step,
  CASE WHEN fails THEN [{", ".join(f"'{s}'" for s in _STEPS)}][k + 1] || ' of ' || job ELSE '' END AS error, CAST(starts AS BIGINT) AS starts, CAST(refused AS BIGINT) AS refused FROM z WHERE back = 1""")
def st03_job_states(spark, d):
    """ST03, ST04, Q09: a log of requests replayed through six steps of three hours, some of which fail: where each key's job stands."""
    requests = M.requests(spark, d).select("key", (F.col("at") * 1000).alias("at"), F.col("event_id").alias("id"))
    machine = jobs.Machine([_step(k) for k in range(6)], delay=10_800_000)
    return jobs.last_states(jobs.replayed(requests, machine), _STEPS)


def _service(name, key):
    if key % 7 == 0:
        raise ValueError(f"no answer for {key}")
    return name if key % 5 else None


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS value, CASE WHEN p_partkey % 7 = 0 THEN 'no answer for ' || p_partkey END AS error FROM part")
def st09_settled_calls(spark, d):
    """ST09: a call for each row, eight at once in a task; each row ends in a value or an error."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    return calls.settled(rows, _service, ["name", "key"], "string").select("key", "value", "error")


def _attempt(key, attempts, partial):
    if int(key) % 5 == 0 or (int(key) % 3 == 0 and attempts < 1):
        raise ValueError(f"attempt {attempts + 1}")
    return f"done {attempts}"


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS state, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts,
CASE WHEN o_orderkey % 5 = 0 THEN 'attempt 3' END AS error, CASE WHEN o_orderkey % 5 <> 0 THEN 'done ' || CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END END AS partial FROM orders""")
def st07_ledger(spark, d):
    """ST07, SK12: keys claimed, tried up to three times with a cool-down between, and kept in a stored ledger."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    now = [1000.0]
    ledger = calls.Ledger.create(keys, fresh_path(spark, "ledger"), buckets=8, attempts=3, cooldown=120)
    ledger.run(_attempt, batch=1_000_000, clock=lambda: now[0], wait=lambda s: now.__setitem__(0, now[0] + s))
    return ledger.rows().select("key", "state", "attempts", "error", "partial")


@query(f"""WITH {M.GUESTS_SQL}, c AS (SELECT c_name AS old, CASE WHEN c_custkey % 3 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') END AS new FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0)
SELECT old, new, count(*) AS episodes, coalesce(new IN (SELECT guest_name FROM guests), false) AS merges FROM c JOIN guests ON guest_name = old GROUP BY old, new""")
def cl16_pending_corrections(spark, d):
    """CL16: corrections of guests' names that links still need, and whether names meet."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    after = F.concat(F.lit("Customer#"), F.lpad((k + 1).cast("string"), 9, "0"))
    renames = c.where(k % 3 == 0).select(F.col("c_name").alias("old"), after.alias("new"))
    return entities.pending_corrections(M.guests(spark, d), renames, c.where((k % 5 == 0) & (k % 3 != 0)).select(F.col("c_name").alias("old")))
