"""WARC archives, Hilbert shards, nearest vectors, benchmark passages, the pipeline."""

import base64
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from scribeflow.llm import ann, decontaminate, hilbert, warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, None, None), (3, "http://a/\n3", "é" * 2000), (4, "u", "<p>same</p>"), (5, "u", ""), (5, "u", ""), (None, "u", "<p>same</p>"), (6, "u", "x" * 3_000_000), (7, "u", "\r\n\r\nContent-Length: 5\r\n")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, sha string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        top = max((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        want.append((str(i), len(b), sha(b), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=lambda r: r[:4]) or sorted(got, key=str) == sorted(want, key=str)
    small = warc.round_trip(df, least_bytes=100).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_reader_refuses_what_is_not_sound():
    records = [warc.record(i, "u", f"<p>{i} some page text</p>".encode() * 9, "response", i, "2024-01-01T00:00:00Z") for i in range(40)]
    data = b"".join(warc.archive(records))
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_MAGIC
    assert list(warc.frames(memoryview(data))) == records
    assert warc.parse(records[3])["page_id"] == 3
    for bad in (data[4:], data[:-3], b"", data[:6]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(memoryview(bad)))
    r = records[0]
    for bad in (r.replace(b"WARC/1.1", b"WORK/1.1"), r.replace(b"WARC-Date", b"WARC-Dote"), r[:-2], r.replace(b"some page", b"sume page"), r.replace(b"Content-Length: ", b"Content-Length: 9"), b"", r.replace(b"WARC-Type: response", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_compressed_dictionary_is_read():
    records = [b"WARC/1.1\r\n" + bytes(f"line {i} " * 30, "ascii") for i in range(300)]
    own = zstandard.train_dictionary(4096, records)
    squeezed = zstandard.compress(own.as_bytes())
    c = zstandard.ZstdCompressor(dict_data=own)
    data = struct.pack("<II", warc.SKIPPABLE_MAGIC, len(squeezed)) + squeezed + b"".join(map(c.compress, records))
    assert list(warc.frames(memoryview(data))) == records


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_curve_visits_each_cell_by_single_steps(dims, bits):
    digit, state = hilbert.curve_table(dims)
    at = {}
    for p in itertools.product(range(1 << bits), repeat=dims):
        s = h = 0
        for level in range(bits - 1, -1, -1):
            i = s * (1 << dims) + sum(((c >> level) & 1) << k for k, c in enumerate(p))
            h, s = h * (1 << dims) + digit[i], state[i]
        at[h] = p
    assert sorted(at) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


@pytest.mark.parametrize("n", [0, 3, 50, 1001])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(i if i % 7 else None, rng.choice(["same text", None, "", f"text {i}" * rng.randint(1, 50)]), rng.choice(["en", None, "de"]), "s", i) for i in range(n)]
    got = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long")).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)] + [(2000, None, "k"), (2001, [0.0] * 16, "k"), (2002, [float("nan")] * 16, "k"), (2003, [None] * 16, "k"), (2004, [1.0] * 3, "k"), (150, x[150].tolist(), "k"), (None, x[3].tolist(), "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), 5, shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(order))
        total += 5
    assert hits / total >= 0.95 and [m[1] for m in sorted(got[100])] == [101, 102, 103, 104, 105]
    two = df.where("vec_id IN (50, 51)")
    assert [(r.query_id, r.vec_id) for r in ann.search(two, two.where("vec_id = 50")).collect()] == [(50, 51)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_best_match_against_a_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, n)).astype(np.uint64) for n in (8, 15))
        e, s, t = decontaminate.best_match(a, b)
        assert e == sellers(a, b) and 0 <= s <= t <= len(b)


def passages(seed, n_items=25):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["the", "of"] * 60
    items = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(n_items)]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 2:
            w = list(items[rng.randrange(n_items)])
            for _ in range(rng.randint(0, int(0.2 * len(w)))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            p = rng.randint(0, len(text))
            text = text[:p] + w + text[p:]
        docs.append(" ".join(text))
    return items, docs


def test_passages_against_all_alignments(spark):
    items, docs = passages(1)
    want = {(d, i) for d, t in enumerate(docs) for i, w in enumerate(items) if sellers(w, t.split()) <= int(0.2 * len(w))}
    assert len(want) > 40
    df = spark.createDataFrame([*[(d, t.title().replace(" ", ", "), 1) for d, t in enumerate(docs)], (500, None, 1), (501, "", 1), (502, "the " * 60_000, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in enumerate(items)], (90, None), (91, "too short"), (None, "x " * 20)], "item_id long, text string")
    rows = decontaminate.find_passages(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert all(r.edits == sellers(items[r.item_id], docs[r.doc_id].split()) for r in rows)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {*range(len(docs)), 500, 501, 502} - {d for d, _ in got}
    assert decontaminate.find_passages(df.limit(0), bench).count() == 0 and decontaminate.find_passages(df, bench.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for name, stage in cp.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == docs.columns, name
        docs = spark.createDataFrame(new.toPandas(), docs.schema)
        n = docs.count()
        assert 0.5 * seen <= n <= seen and docs.select("doc_id").distinct().count() == n
        seen = n
    out = cp.STAGES[-1][1](spark, docs, sf)
    assert out.count() == seen and {r.doc_id for r in out.collect()} == {r.doc_id for r in cp.run(spark, sf).collect()}


def test_pipeline_keeps_odd_rows(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    one = spark.read.parquet(f"{sf}/documents.parquet").limit(1).drop("n_chars")
    odd = spark.createDataFrame([(None, "a text of its own", None, None), (None, None, None, None), (10**9, "", None, None), (10**9, "", None, None)], one.schema)
    docs = one.unionByName(odd)
    left = cp.dedup_stage(spark, docs, sf).collect()
    assert sum(r.doc_id is None for r in left) == 2 and sum(r.doc_id == 10**9 for r in left) == 1
    assert cp.pii_stage(spark, odd.limit(0), sf).count() == 0 and cp.bpe_stage(spark, odd, sf).count() == 4


def test_vectors_beyond_the_range_of_squares(spark):
    """Components whose squares overflow or underflow a double take part, with true cosines."""
    rows = [(0, [3e200, 4e200]), (1, [3e-200, 4e-200]), (2, [4e200, -3e200]), (3, [5e-324, 0.0]), (4, [1.0, 1.0]), (50, [6.0, 8.0]), (51, [float("inf"), 1.0]), (52, [0.0, 0.0]), (53, None), (54, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, df.where("vec_id % 50 = 0"), 5).collect()}
    want = {(0, 1): 1.0, (0, 50): 1.0, (0, 2): 0.0, (0, 3): 0.6, (0, 4): 7 / 5 / 2**0.5}
    want |= {(50, v): s for (_, v), s in want.items() if v != 50} | {(50, 0): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("n", [1500, 6000, 24_000])
def test_recall_at_three_sizes(spark, n):
    """The shards and the blocks of queries grow with the table; recall stays, and no row more than the answers is made."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), 5, shard_rows=1500, block=100).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len({v for _, v in found[q]} & set(np.argsort(-s)[:5].tolist()))
        assert sorted(r for r, _ in found[q]) == [1, 2, 3, 4, 5]
    assert len(found) == n // 50 and hits >= 0.9 * 5 * len(found)


def test_common_pages_are_spread(spark):
    """A page that half of the rows share, another that many share, and single ones: against a plain count."""
    rows = [(i, f"u{i}", "<p>top</p>" if i % 2 else "<p>some</p>" if i % 3 else f"<p>{i}</p>") for i in range(3000)] + [(None, None, "<p>null id</p>")] * 2
    got = {(r.page_id, r.record_type, r.refers_to): r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    top, some = 2999, max(i for i in range(3000) if i % 2 == 0 and i % 3)
    want = {(i, *(("revisit", top) if i % 2 and i != top else ("revisit", some) if i % 2 == 0 and i % 3 and i != some else ("response", None))) for i in range(3000)}
    assert set(got) == want | {(None, "response", None)}
    assert len({r.payload_digest for r in got.values()}) == 3 + sum(1 for i in range(3000) if i % 2 == 0 and i % 3 == 0)
