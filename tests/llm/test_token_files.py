"""Re-Pair shards of token ids: the grammar, ranges, files, and the whole round trip on odd rows."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scribeflow.llm import repair

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "  ", "don't we'll   see\n\n x", "naïve 東京 🙂", "one<|endoftext|>two <|endoftext|>", "<|endoftext|>", "the cat sat on the mat " * 500, "word " * 3000, "x" * 5000, "12345 67,8"]


class Held(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 5))
def test_grammar_expands_to_its_ids(ids, times):
    ids = np.array(ids * times, np.uint32)
    one = repair.Shard(repair.packed_shard(ids))
    assert one.ids(0, len(ids)).tolist() == ids.tolist()
    for a in range(0, len(ids), 37):
        assert one.ids(a, min(len(ids), a + 11)).tolist() == ids[a : a + 11].tolist()


def test_rules_are_frequent_pairs_and_shorten():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50_000, 400), *[np.arange(100, 140)] * 60, np.full(1000, 9), rng.integers(0, 9, 4000)]).astype(np.uint32)
    base, rules, seq = repair.grammar(ids)
    assert len(seq) < len(ids) / 2 and (rules < base + np.arange(len(rules))[:, None]).all()
    uses = np.bincount(np.concatenate([rules.reshape(-1), seq]), minlength=base + len(rules))[base:]
    assert (uses >= 1).all() and len(np.unique(rules, axis=0)) == len(rules)
    # each rule replaced its pair LEAST times at least: its uses, or those that later rules took over
    counts = np.zeros(base + len(rules), np.int64)
    np.add.at(counts, seq, 1)
    for k in range(len(rules) - 1, -1, -1):
        counts[rules[k]] += counts[base + k]
    assert (counts[base:] >= repair.LEAST).all()
    sizes = repair.expansions(base, rules)
    assert all(sizes[k] == sum(1 if s < base else sizes[s - base] for s in rules[k]) for k in range(len(rules)))


def test_empty_and_single():
    for ids in ([], [7]):
        assert repair.Shard(repair.packed_shard(np.array(ids, np.uint32))).ids(0, len(ids)).tolist() == ids


@pytest.mark.parametrize("slots", [1 << 16, 16, 1])
def test_encoder_is_the_library(slots):
    enc, tk = repair.Encoder(PATH, slots), Tokenizer.from_file(PATH)
    want = [e.ids + [0] for e in tk.encode_batch(TEXTS * 2, add_special_tokens=False)]
    for limit in (1_000_000, 3000, 40):
        parts = list(repair.documents_of(enc, TEXTS * 2, limit))
        assert np.concatenate([p for p, _ in parts]).tolist() == sum(want, [])
        assert np.concatenate([s for _, s in parts]).tolist() == list(map(len, want))


def file_of(docs, shard):
    sink = Held()
    w = repair.Writer(sink, shard)
    for name, ids in docs:
        w.names.append(name)
        w.add(np.array(ids, np.uint32))
        w.sizes.append(len(ids))
    w.close()
    return sink.getvalue()


def test_file_gives_any_document_and_range():
    rng = np.random.default_rng(1)
    docs = [(None, [0]), (-5, [1, 2, 0]), *((i, [*rng.integers(0, 40, int(rng.integers(0, 300))), 0]) for i in range(60)), (99, [*rng.integers(0, 9, 5000), 0])]
    blob = file_of(docs, 512)
    a = repair.Archive(Held(blob))
    flat = np.concatenate([x for _, x in docs])
    assert a.doc_ids == [n for n, _ in docs] and a.total == len(flat) and len(a.firsts) > 10
    for k in rng.permutation(len(docs)):
        assert a.document(k).tolist() == list(docs[k][1])
    for lo in range(0, len(flat), 613):
        assert a.ids(lo, min(len(flat), lo + 1500)).tolist() == flat[lo : lo + 1500].tolist()
    assert repair.Archive(Held(file_of([], 512))).total == 0


def test_damage_is_refused():
    blob = file_of([(1, list(range(600)) * 3)], 512)
    for bad in (b"", blob[:-1], blob[:-30] + b"x" + blob[-29:], b"x" * 100):
        with pytest.raises(ValueError):
            repair.Archive(Held(bad))
    hurt = bytearray(blob)
    hurt[40] ^= 1
    with pytest.raises(ValueError):
        repair.Archive(Held(bytes(hurt))).document(0)


def plain(rows):
    """What the files must give: rows by id, ids by the library."""
    tk, out, at = Tokenizer.from_file(PATH), [], 0
    for name, text in rows:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard, parts", [(1 << 18, None), (300, 3)])
def test_round_trip_on_odd_rows(spark, shard, parts):
    rows = [(None, "no id"), *((i, t) for i, t in enumerate(TEXTS)), (20, None), (30, "same same"), (30, "same same"), (-4, "first"), (40, "lone " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("hash", "row", "part", "path", "start", "ids", "base")})
    folder = repair.fresh_path(spark, "ids")
    made = repair.write(docs.repartition(4), folder, shard=shard, parts=parts)
    got = repair.read(made, folder, ids=True).collect()
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in got) == [(n is not None, n or 0, *r) for n, *r in want]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert [(r.doc_id, r.start) for r in repair.round_trip(docs.where("doc_id = 20")).collect()] == [(20, 0)]
    assert repair.round_trip(docs.limit(0)).count() == 0


def test_copies_of_one_row_are_spread(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("copy of a row").alias("text")).repartition(8)
    folder = repair.fresh_path(spark, "ids")
    made = repair.write(docs, folder, parts=4)
    assert max(r.docs for r in made.collect()) < 2000
    got = repair.read(made, folder)
    assert sorted(r.start for r in got.collect()) == [5 * i for i in range(4000)]
