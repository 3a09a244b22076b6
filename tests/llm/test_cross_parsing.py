"""Cross-parsing against a plain parse: several languages, borders of pieces and runs, argmin, score, large scripts."""

import random

import numpy as np
import pytest

from scribeflow.llm import langid


def plain_phrases(z, known):
    """Phrases of the longest-match parse of z against the substrings of the known texts."""
    n = i = 0
    while i < len(z):
        j = i
        while j < len(z) and any(z[i : j + 1] in k for k in known):
            j += 1
        n += j < len(z)
        i = j + (j == i)
    return n


def text_of(c):
    return "".join(map(chr, c))


def plain_prediction(text, references):
    z = text_of(langid.normal(text))
    if not z:
        return "und", 0.0
    rates = [plain_phrases(z, [text_of(langid.normal(t)) for t in texts]) / len(z) for _, texts in references]
    odds = np.exp(-12 * (np.array(rates) - min(rates)))
    return references[int(np.argmin(rates))][0], odds.max() / odds.sum()


@pytest.mark.parametrize("piece, run", [(4, 50), (16, 10_000), (512, 200)])
def test_predictions_equal_a_plain_parse(monkeypatch, piece, run):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "_CHARS", run)
    rng = random.Random(piece)
    alphabets = {"aa": "abc ", "bb": "abd ", "cc": "bcx.é "}
    make = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    references = tuple((k, tuple(make(s, rng.randint(1, 40)) for _ in range(4))) for k, s in alphabets.items())
    texts = [make(rng.choice(["abcdx ", "ab ", "a", "abc.é é", ". !", "ab c" * 3]), rng.randint(0, 900)) for _ in range(60)] + [None, "", "a" * 3000, "ab " * 800]
    langs, scores = langid.Parser(references).predict(texts)
    for x, lang, score in zip(texts, langs, scores, strict=True):
        want = plain_prediction(x or "", references)
        assert (lang, pytest.approx(score)) == want, x


def test_periodic_texts_that_never_meet():
    """A text whose parse depends on where it began takes the plain walk: borders of pieces end no phrase."""
    references = (("x", ("a" * 37,)), ("y", ("ab" * 20,)))
    p = langid.Parser(references)
    z = "a" * 20_000
    ended, _ = p.phrases([p.symbol[langid.normal(z)]], np.zeros((2, 1), np.int64))
    assert ended[0, 0] == (len(z) - 1) // 37 == plain_phrases(z, ["a" * 37])
    assert ended[1, 0] == plain_phrases(z, ["ab" * 20])


def test_scripts_of_many_letters():
    """Three languages, two of them with scripts of 1,500 letters of their own; a small table sends most to the sorted lists."""
    rng = random.Random(9)
    scripts = {"latin": [chr(c) for c in range(97, 123)], "one": [chr(c) for c in range(0x4E00, 0x4E00 + 1500)], "two": [chr(c) for c in range(0x6000, 0x6000 + 1500)]}
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(n))
    references = tuple((k, tuple(make(s, 90) for _ in range(20))) for k, s in scripts.items())
    for tables in (langid.TABLES, 4_000_000):
        langid_tables, langid.TABLES = langid.TABLES, tables
        try:
            p = langid.Parser(references)
        finally:
            langid.TABLES = langid_tables
        texts = [(k, make(s, rng.choice([3, 40, 700]))) for k, s in scripts.items() for _ in range(30)]
        langs, scores = p.predict([x for _, x in texts])
        assert langs == [k for k, _ in texts] and min(scores) > 0.34
