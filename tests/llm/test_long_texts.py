"""Very long texts are worked through in runs, with the results of the whole; the learner against a plain loop; the curve's column."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeflow.llm import chars, decontaminate, hilbert, tokencount, toxicity


def prose(seed, n, words=60):
    rng = random.Random(seed)
    own = [f"w{i}" for i in range(words)] + ["-", "!!", "你好", "x," * 3, "end."]
    return "".join(rng.choice(own) + rng.choice([" ", "  ", "\n", " \t "]) for _ in range(n))


@pytest.mark.parametrize("limit", [40, 333, 5000])
def test_toxicity_in_runs(monkeypatch, limit):
    texts = [prose(limit, 700), "- - -" * 90 + " a b", "lone" * 400, " ", "", None, "one two"]
    whole = [toxicity.features([x]) for x in texts]
    rng = np.random.default_rng(1)
    model = rng.normal(size=1 << toxicity.BITS) * (rng.random(1 << toxicity.BITS) < 0.3)
    scores = [toxicity.scores([x], model, -0.1)[0] for x in texts]
    monkeypatch.setattr(toxicity, "_CHARS", limit)
    for x, (places, _), score in zip(texts, whole, scores, strict=True):
        assert (toxicity.features([x])[0] == places).all() and toxicity.scores([x], model, -0.1)[0] == pytest.approx(score)


@pytest.mark.parametrize("limit", [60, 400])
def test_passages_in_runs(monkeypatch, limit):
    items = [prose(i, n).strip() for i, n in enumerate((2, 3, 6, 9, 14, 40))]
    filler = prose(77, 500, 4000)
    text = filler[:1500] + items[5] + " " + filler[1500:] + items[0] + " . " + items[3] + " " + items[2]
    index = decontaminate.Index(list(range(10, 16)), items)
    want = index.matches([text])
    monkeypatch.setattr(decontaminate, "_CHARS", limit)
    assert index.matches([text]) == want and {m[1] for m in want} >= {10, 12, 13, 15}


def test_token_counts_of_a_long_text(spark):
    import public_tokenizers

    text = prose(5, 900_000, 5000) + "<|endoftext|>" + "lone" * 50_000
    assert len(text) > tokencount._CHARS
    got = tokencount.count_tokens(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).collect()
    want = len(tokencount.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False))
    assert {r.doc_id: r.n_tokens for r in got} == {1: want, 2: 2}


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError):
        tokencount.specials(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = json.load(f)
    own["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(own))
    with pytest.raises(ValueError):
        tokencount.specials(str(tmp_path / "t.json"))


def test_rounds_and_tails():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["ab", " ", "-", "\n", "é"]) for _ in range(rng.randint(0, 60)))
        assert "".join(p[0] for p in chars.rounds([t], 7)) == t
        end = chars.tail(t, 2, chars.word_spans)
        assert t.endswith(end) and (end == t or chars.word_spans([end])[3][1] >= 2)


def plain_ftrl(examples, rate, beta, l1, l2, epochs):
    """McMahan's per-coordinate FTRL-proximal, one coordinate at a time, with a plainly learned intercept."""
    z, n = {}, {}
    share = min(0.99, max(0.01, sum(y for _, y in examples) / len(examples)))
    bias, bias_n = math.log(share / (1 - share)), 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / rate + l2)

    for _ in range(epochs):
        for places, y in examples:
            w = {i: weight(i) for i in places.tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in w:
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / rate
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = old + g * g
            bias_n += g * g
            bias -= 0.1 * rate * g / (beta + math.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


@pytest.mark.parametrize("l1", [0.2, 1.0])
def test_training_equals_a_plain_loop(l1):
    rng = np.random.default_rng(3)
    examples = []
    for i in range(120):
        y = int(i % 3 == 0)
        examples.append((np.unique(np.append(rng.integers(0, 60, 12), [61] * y)).astype(np.int32), y))
    places, weights, bias = toxicity.train(examples, l1=l1, epochs=4)
    want, want_bias = plain_ftrl(examples, 0.5, 1.0, l1, 1.0, 4)
    assert dict(zip(places.tolist(), weights, strict=True)) == pytest.approx(want) and bias == pytest.approx(want_bias)
    assert 61 in want and want[61] == max(want.values())


def test_curve_column_equals_the_table(spark):
    digit, state = hilbert.curve_table(3)
    cells = list(itertools.product(range(0, 64, 9), repeat=3)) + [(63, 63, 63), (1, 62, 33)]
    rows = spark.createDataFrame(cells, "a int, b int, c int").withColumn("h", hilbert.hilbert_index([F.col(x) for x in "abc"], 6)).collect()
    for r in rows:
        s = h = 0
        for level in range(5, -1, -1):
            i = s * 8 + sum(((c >> level) & 1) << k for k, c in enumerate((r.a, r.b, r.c)))
            h, s = h * 8 + digit[i], state[i]
        assert r.h == h


def test_shards_prune_and_hold_odd_rows(spark):
    """A filter on one dimension meets few shards; copies, very long texts and clashing columns are placed like others."""
    rng = random.Random(6)
    rows = [(i, "t " * rng.choice([3, 40, 600]), f"l{rng.randrange(8)}", f"s{rng.randrange(8)}", "x", 1) for i in range(3000)]
    rows += [(9000, "same", "l1", "s1", "x", 1)] * 1500 + [(9001, "long " * 400_000, "l2", "s2", "x", 1), (9002, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve string, slot int")
    got = hilbert.shard(docs).join(docs.select("doc_id", "lang", "source").distinct(), "doc_id").collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    own = [r for r in got if r.doc_id < 9000]
    spread = lambda key: np.mean([len({r.shard for r in own if key(r) == v}) for v in {key(r) for r in own}])
    assert spread(lambda r: (r.lang, r.source)) < 2.5 and spread(lambda r: r.lang) < 6.5
    assert hilbert.log_cell(F.lit(2_000_000), 6) is not None and len({r[0] for r in spark.range(10, 31).select(hilbert.log_cell(F.pow(F.lit(2.0), "id"), 6)).collect()}) == 21
