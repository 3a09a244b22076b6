"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.llm import annulus, ann, bpe, decontaminate, hilbert, langid, merkle, neardup, pii, repair, tokencount, toxicity, warc
from scribeflow.runtime import bounded_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    @wraps(f)
    def bounded(spark, sf_dir):
        bounded_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = bounded
    return bounded


@query
def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=(85, 100))


SQL["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}',
    1 + (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM p JOIN r USING (h)
"""


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs, langid.fit(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op6_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_hilbert_sharding(spark, sf_dir):
    return hilbert.shard(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_passages(spark, sf_dir):
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_byte_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


@query
def op10_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(docs))


@query
def op11_repair_ids(spark, sf_dir):
    return repair.round_trip(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, even, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})


_PARTS = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in merkle.LEAF]
#: Reflected crc32 of ASCII text x, bit by bit, before its last inversion (which turns an even sum odd).
_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(x) + 1), lambda i: CAST(ascii(substr(x, CAST(i AS INT), 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda j: CAST(0 AS BIGINT))), lambda u, z: xor(u >> 1, (u & 1) * 3988292384)))"""
_PARENTS = "list_transform(range((len(n) + 2) // 3), lambda i: sha256(array_to_string(n[3 * i + 1:3 * i + 3], '')))"
SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS x FROM documents),
f AS (SELECT doc_id, source, sha256({" || ".join(_PARTS)}) AS leaf, sha256({" || ".join(_PARTS).replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")}) AS other, {_CRC} & 1 = 1 AS changed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM f),
t AS (SELECT source, 0 AS l, list(leaf ORDER BY i) AS n FROM o GROUP BY source UNION ALL SELECT source, l + 1, {_PARENTS} FROM t WHERE len(n) > 1),
s AS (SELECT source, l AS top, n[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM t WHERE len(n) = 1),
u AS (SELECT 0 AS l, list(subroot ORDER BY j) AS n FROM s UNION ALL SELECT l + 1, {_PARENTS} FROM u WHERE len(n) > 1),
e AS (SELECT l AS last, n[1] AS root FROM u WHERE len(n) = 1),
a AS (SELECT o.doc_id, o.leaf, CASE WHEN changed THEN other ELSE leaf END AS start, s.subroot, e.root, o.source, o.i, s.j, s.top, e.last FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source, e),
steps AS (SELECT a.doc_id, t.l AS h, a.i // CAST(power(3, t.l) AS BIGINT) AS p, t.n FROM a JOIN t ON t.source IS NOT DISTINCT FROM a.source AND t.l < a.top
  UNION ALL SELECT a.doc_id, a.top + u.l, a.j // CAST(power(3, u.l) AS BIGINT), u.n FROM a JOIN u ON u.l < a.last),
runs AS (SELECT doc_id, h, array_to_string(list_slice(n, p // 3 * 3 + 1, p), '') AS before, array_to_string(list_slice(n, p + 2, p // 3 * 3 + 3), '') AS behind FROM steps),
proof AS (SELECT doc_id, sha256(string_agg(before || behind, '' ORDER BY h)) AS proof_sha256 FROM runs GROUP BY doc_id),
w AS (SELECT doc_id, 0 AS h, start AS node FROM a UNION ALL SELECT w.doc_id, w.h + 1, sha256(before || node || behind) FROM w JOIN runs r ON r.doc_id = w.doc_id AND r.h = w.h),
g AS (SELECT doc_id, max_by(node, h) AS folded_root FROM w GROUP BY doc_id)
SELECT a.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM a JOIN g ON g.doc_id = a.doc_id LEFT JOIN proof ON proof.doc_id = a.doc_id
"""


@query
def op13_annulus_clusters(spark, sf_dir):
    return annulus.cluster(table(spark, sf_dir, "embeddings"))


def _centroid_round(r: int) -> str:
    """SQL for the assignment a{r} to centroids c{r}, and the centroids after it."""
    return f"""
a{r} AS (SELECT vec_id, v, c, distance FROM (SELECT q.vec_id, q.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS distance FROM q, c{r} c) x
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1),
m{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{r + 1} AS (SELECT c.c, coalesce(w.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY c) w ON w.c = c.c)"""


SQL["op13_annulus_clusters"] = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM q QUALIFY c < 16),
{",".join(_centroid_round(r) for r in range(4))}
SELECT vec_id, CAST(a3.c AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = a3.c
"""


def all_queries():
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_sql():
    return SQL
