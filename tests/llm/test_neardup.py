"""Near duplicates and components against all pairs."""

import random
import re

import numpy as np
import pytest

from scribeflow.llm import neardup
from scribeflow.llm.components import components

DDL = "doc_id long, text string, key string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, parts):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and parts[1] * len(a & b) >= parts[0] * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [rng.choice(vocab)]
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "ONE TWO"), (n + 5, "one"), (n + 6, "x " * 30_000)]


@pytest.mark.parametrize("k, parts, leaf, bulk", [(3, (85, 100), 2048, 1 << 22), (5, (80, 100), 2048, 150), (3, (85, 100), 6, 300)])
def test_groups_equal_all_pairs(spark, monkeypatch, k, parts, leaf, bulk):
    monkeypatch.setattr(neardup, "LEAF", leaf)  # small nodes make the trees branch
    monkeypatch.setattr(neardup, "BULK", bulk)  # few shingles make pairs of blocks
    monkeypatch.setattr(neardup, "BLOCK", max(3, leaf // 2))
    rows = corpus(k + leaf)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], DDL)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, k, parts).collect()}
    want = brute(rows, k, parts)
    assert {i: g[:2] for i, g in got.items()} == want
    assert all(g[2] == (g[1] == i) for i, g in got.items())


def test_one_hot_group(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i + 10, " ".join(w)))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows + [(5, "other text of its own here")] * 3], DDL)
    got = neardup.near_duplicates(df, 3, (85, 100)).collect()
    assert {r.component_id for r in got if r.doc_id >= 10} == {10} and sum(r.doc_id == 5 for r in got) == 3


def test_rows_that_repeat_an_id(spark):
    """A third of all rows are one row; others have two texts, of which each has its copies."""
    text = lambda i, n=40: " ".join(f"t{i}w{j}" for j in range(n))
    rows = [(7, text(0))] * 400 + [(8, text(0) + " more"), (9, text(1)), (9, text(2)), (10, text(1)), (11, text(2) + " end"), (12, text(3)), (6, text(4)), (12, text(4))] + [(i, text(i)) for i in range(20, 200)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([(i, t, "k") for i, t in rows], DDL), 3, (85, 100)).collect()}
    assert got == {i: i for i, _ in rows} | {8: 7, 10: 9, 11: 9, 12: 6}


def test_nothing_and_nulls(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f", "x"), (1, None, None)], DDL)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, False), (1, 1, True)}


def test_exact_links_in_strips(monkeypatch):
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64) * 2)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(0, 2**63, 9).astype(np.uint64)])) for _ in range(30)]
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (neardup.exact_links(sets, (70, 100)) == want).all()
    big = [np.repeat(np.arange(300_000, dtype=np.uint64) * 61_489_146_912_365, 1) + np.uint64(i) * np.uint64(0) for i in range(8)]
    assert neardup.exact_links([np.sort(b) for b in big], (85, 100)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("fan", [1, 256])
def test_trees_of_links_equal_all_pairs(spark, monkeypatch, fan):
    """Families around the threshold, in which some links of a tree fail, against all pairs; ids with several texts among them."""
    monkeypatch.setattr(neardup, "FAN", fan)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows, ident = [], 0
    for _ in range(12):
        base = [word() for _ in range(60)]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(60)] = word()
            rows.append((ident, " ".join(words)))
            ident += rng.randint(0, 1)  # some ids have several texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=3, similarity=(85, 100)).collect()}
    sets = [(i, {tuple(t.split()[j : j + 3]) for j in range(58)}) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if 100 * len(x & y) >= 85 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in root}
    assert 1 < len(set(got.values())) < len(got)


def test_spanning_forest_is_of_heaviest_links():
    weight = np.array([[0, 5, 3, 0], [5, 0, 4, 0], [3, 4, 0, 0], [0, 0, 0, 0]], np.uint8)
    first, parent = neardup._spanning_forest(weight)
    assert first.tolist() == [0, 0, 0, 3] and parent.tolist() == [0, 0, 1, 3]
