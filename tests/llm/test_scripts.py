"""Language identification with large alphabets and with very many languages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeflow.llm import langid


@pytest.mark.parametrize("tables", [128_000_000, 0, 3 * 4 * 2 * langid.SYMBOLS * 5])
def test_cross_parsing_of_large_alphabets(monkeypatch, tables):
    monkeypatch.setattr(langid, "TABLES", tables)  # none, a few or all transitions are in tables
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(250)]
    for _ in range(8):
        sets = [rng.sample(letters, 140) for _ in range(3)]
        texts = ["".join(rng.choices(s, [1 / (i + 1) for i in range(140)], k=400)) for s in sets]
        p = langid.Parser(tuple((f"l{i}", (t,)) for i, t in enumerate(texts)))
        z = "".join(x[k : k + 5] for k in range(0, 60, 5) for x in texts)
        want = []
        for t in texts:
            n = i = 0
            while i < len(z):
                j = i
                while j < len(z) and z[i : j + 1] in t:
                    j += 1
                n += j < len(z)
                i = j + (j == i)
            want.append(n)
        s = p.symbol[np.frombuffer(z.encode("utf-32-le"), np.uint32)].astype(np.int64)
        assert p.phrases([s], np.zeros((3, 1), np.int64))[0][:, 0].tolist() == want


def test_languages_of_many_letters():
    """Two languages over the same 900 letters, told apart by the pairs they use; a third takes the frequent letters."""
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(900)]
    words = {lang: [a + b for a, b in zip(rng.sample(letters, 900), rng.sample(letters, 900), strict=True)] for lang in ("xx", "yy")}
    words["aa"] = [chr(0x430 + i % 30) + chr(0x3B1 + i // 30) for i in range(700)]
    text = lambda lang, n: "".join(rng.choices(words[lang], k=n))
    p = langid.Parser(tuple((lang, tuple(text(lang, 700) for _ in range(9))) for lang in sorted(words)))
    asked = [lang for lang in words for _ in range(30)]
    assert p.predict([text(lang, 60) for lang in asked])[0] == asked


def test_every_language_counts(spark):
    n = 203
    name = F.format_string("l%03d", F.col("id") % n)
    docs = spark.range(n * langid.DOCS).select(F.col("id").alias("doc_id"), F.expr(f"repeat(decode(unhex(hex(19968 + id % {n})), 'UTF-16BE'), 9)").alias("text"), name.alias("lang"))
    found = langid.fit(docs)
    assert [k for k, _ in found] == [f"l{i:03d}" for i in range(n)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where(f"doc_id < {n}"), found).collect()}
    assert got == {i: f"l{i:03d}" for i in range(n)}
