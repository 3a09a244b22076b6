"""Words, pre-tokens, hashes, token counts and BPE against the libraries themselves."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import regex

from scribeflow.llm import bpe, chars, tokencount

HARD = [
    "", " ", "  ", "a", "it's we'll I'd they've 'S 's 're", "''s '' ' 'll'", "x  's", "x\n's", "tab\t\tword", "end  ", "end \n", "\n\n a", "a b  c", "naïve café ÉCOLE ß", "日本語 テキスト 12３ ½", "é ​ zero",
    "12,345.67!? --- ...", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "🙂🙂 ok 🙂", "\x1c\x1f\x85 odd", "mixed123abc", "(it's)", "don''t", "we've'll", "x" * 3000, " " * 500 + "a", "'re" * 40, "a'", "'", " '", "\r\n\r\n x",
]


@pytest.mark.parametrize("text", HARD)
def test_pretokens_are_the_patterns_matches(text):
    c, starts = chars.pretokens(text, np.array([0]))
    ends = [*starts[1:].tolist(), len(c)][: len(starts)]
    assert [text[a:b] for a, b in zip(starts.tolist(), ends, strict=True)] == regex.findall(P.PATTERN, text)


def test_words():
    h, at = chars.words(["One  two\tONE", None, "", "twó x\x0b", " "])
    assert at.tolist() == [0, 3, 3, 3, 5, 5] and h[0] == h[2] and len(set(h.tolist())) == 4
    texts = ["a b " * 50, "é " * 10, "x"]
    alone = np.concatenate([chars.words([t])[0] for t in texts])
    assert (chars.words(texts)[0] == alone).all()  # the batch doesn't matter
    assert len(re.findall(r"[^\x20\x09-\x0D]+", texts[0])) == 100


def rows(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")


def test_token_counts_equal_the_library(spark):
    tk = tokencount.tokenizer(P.path("byte_bpe_50k.json"))
    texts = [*HARD, None, "a b", "a b"]
    for top in (0, 5, 100_000):
        got = {r.doc_id: r for r in tokencount.count_tokens(rows(spark, texts), top=top, over=3).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n = len(tk.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 3), t


def test_token_counts_of_nothing(spark):
    assert tokencount.count_tokens(rows(spark, ["a"]).limit(0)).count() == 0


def test_bpe_equals_the_library_and_returns(spark):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [*HARD, None]
    got = {r.doc_id: r for r in bpe.encode(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(rows(spark, texts))).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [1, 3, 10, 100])
def test_long_texts_are_cut_safely(limit):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in HARD:
        t = (t + " ") * 3
        assert "".join(chars.runs(t, limit)) == t
        assert bpe.encode_text(t, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, limit).tolist() == enc.encode_ordinary(t)
