"""Benchmark passages of few words and in scripts without blanks, against brute force."""

import random

import pytest

from scribeflow.llm import chars, decontaminate


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_short_passages_against_all_alignments(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    items = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 6, 6, 6, 7, 7, 7)]
    docs = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    for d in docs[::2]:  # altered copies
        w = list(rng.choice(items))
        p = rng.randrange(len(w))
        w[p : p + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        d[len(d) // 2 : len(d) // 2] = w
    own = decontaminate.Index([*range(len(items)), 99], [" ".join(w) for w in items] + [" ?! "])
    got = {(t, i): (s, n, e) for t, i, s, n, e in own.matches([" ".join(d) for d in docs])}
    want = {(t, i): sellers(w, d) for t, d in enumerate(docs) for i, w in enumerate(items) if sellers(w, d) <= int(0.2 * len(w))}
    assert {k: e for k, (*_, e) in got.items()} == want
    for (t, i), (s, n, e) in got.items():
        assert sellers(items[i], docs[t][s : s + n]) == e
        if e == 0:
            assert s == min(k for k in range(len(docs[t])) if docs[t][k : k + len(items[i])] == items[i])


def test_spans_of_scripts_without_blanks():
    texts = ["Ab 漢字kana、カナ。x", None, "ไทย café", "𠀀𠀁 plain", "「漢」", ""]
    low, starts, lengths, at = chars.symbol_spans(texts)
    got = [low[s : s + n].tobytes().decode() for s, n in zip(starts, lengths, strict=True)]
    want = [["ab", "漢", "字", "kana", "カ", "ナ", "x"], [], ["ไ", "ท", "ย", "café"], ["𠀀", "𠀁", "plain"], ["漢"], []]
    assert [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_passages_of_any_length_and_script(spark):
    rng = random.Random(9)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n))
    thai = lambda n: "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(n))
    long_han, long_thai, short_han = han(60), thai(50), han(4)
    altered = long_han[:20] + han(3) + long_han[23:40] + long_han[41:]
    bench = spark.createDataFrame([(1, "Paris, France"), (2, long_han), (3, long_thai), (4, short_han), (5, "what is the capital city"), (6, ""), (7, "。 ?!")], "item_id long, text string")
    docs = [(10, "it lies in paris france. so"), (11, han(80) + altered + han(30)), (12, thai(40) + long_thai + thai(9)), (13, f"x {han(9)}{short_han}、{han(9)}"), (14, "What was the capital city of it?"), (15, "paris in france"), (16, han(300)), (17, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_passages(df, bench).collect()}
    assert got == {(10, 1, 0), (11, 2, 4), (12, 3, 0), (13, 4, 0), (14, 5, 1)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {15, 16, 17}


def test_blocks_of_passages_are_searched_each(spark):
    """Many blocks, read by tasks, give what one block gives; rows without an id or with a repeated one are judged by their own text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)] + [(90, "zebra quagga"), (None, "x y"), (91, None), (92, "")]
    texts = [(i, " ".join([*(word() for _ in range(9)), items[i % 30][1] if i % 2 else word(), word()])) for i in range(40)]
    docs = spark.createDataFrame([*texts, (None, "a zebra quagga here"), (7, "another text with the same id"), (50, None), (51, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    for call in (decontaminate.find_passages, decontaminate.drop_contaminated):
        one = rows(call(docs, benchmark))
        assert rows(call(docs, benchmark, block_words=60)) == one and one
    left = decontaminate.drop_contaminated(docs, benchmark, block_words=60).collect()
    assert sorted((r.doc_id for r in left), key=str) == sorted([*range(0, 40, 2), 7, 50, 51], key=str)
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.find_passages(docs, benchmark.limit(0)).count() == 0
