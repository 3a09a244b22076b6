"""The registered queries themselves: columns, held-out rules, query sets and thresholds, and the SQL where there is one."""

import zlib

import duckdb
import numpy as np
import pytest

from scribeflow.llm import queries
from tests.conftest import SMALL

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op2_near_duplicates": "doc_id n_shingles component_id kept", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_language_id": "doc_id held_out lang_pred score", "op5_nearest_vectors": "query_id rank vec_id score", "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op7_hilbert_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op11_repair_ids": "doc_id start n_tokens ids_crc32",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_annulus_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.fixture(scope="module")
def got(spark):
    kept = {}

    def run(name):
        if name not in kept:
            kept[name] = queries.all_queries()[name](spark, SMALL).toPandas()
        return kept[name]

    return run


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(got, name):
    want = COLUMNS[name].split()
    assert list(got(name).columns)[: len(want)] == want and len(got(name))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(got, db, name):
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got(name)) == rows(db.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name, mod, left", [("op1_toxicity", 3, 1), ("op4_language_id", 4, 2)])
def test_held_out_rows(got, db, name, mod, left):
    df = got(name)
    assert len(df) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert [bool(x) for x in df.held_out] == [zlib.crc32(str(i).encode()) % mod == left for i in df.doc_id]
    assert df.score.between(0, 1).all()


def test_toxicity_threshold(got):
    df = got("op1_toxicity")
    assert ((df.score >= 0.7).astype(int) == df.predicted).all()


def test_nearest_vectors_against_all(got, db):
    rows = db.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    df = got("op5_nearest_vectors").sort_values(["query_id", "rank"])
    assert sorted(set(df.query_id)) == sorted(i for i in ids if i % 50 == 0)
    found = {q: list(g.vec_id) for q, g in df.groupby("query_id")}
    hits = 0
    for q, near in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        order = [i for _, i in sorted(zip(np.round(-(unit @ unit[at]), 12), ids, strict=True)) if i != q][:5]
        hits += len(set(order) & set(near))
    assert hits >= 0.9 * 5 * len(found)
