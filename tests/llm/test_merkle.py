"""The Merkle manifest against a plain tree: traversal, proofs, tampering, odd rows, deep trees and many sources."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scribeflow.llm import merkle


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels_above(leaves, levels=None):
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    path = []
    for nodes in tree[:-1]:
        run = i // 3 * 3
        path.append((nodes[run:i], nodes[i + 1 : run + 3]))
        i //= 3
    return path


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82, 300, 729])
def test_traversal_gives_each_leaf_its_siblings(n):
    leaves = [H(str(i)) for i in range(n)]
    for levels in {merkle.levels_of(n), 6}:
        held = []
        tree = levels_above(leaves, levels)
        assert list(merkle.traversal(leaves, levels, held)) == [siblings(tree, i) for i in range(n)]
        assert merkle.root_of(leaves, levels) == tree[-1][0]
        assert max(held) <= 6 * max(1, levels)  # nodes kept: in proportion to the levels, not the leaves


def plain(rows, tampered=True):
    """The contract, row by row."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels_above([leaf(r) for r in by[s]]) for s in names}
    top = levels_above([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, j)
            start = leaf(r)
            if tampered and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                start = leaf((*r[:4], r[4].replace("\n", "")))
            end = start
            for a, b in path:
                end = H("".join([*a, end, *b]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(x for a, b in path for x in [*a, *b])), end, end == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def asked(docs, **more):
    even, no_breaks = F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return sorted((tuple(r) for r in merkle.manifest(docs, even, {"text": no_breaks}, **more).collect()), key=str)


def test_odd_rows(spark):
    rows = [(i, "a", "en", 3, f"line {i}\nmore") for i in range(40)]
    rows += [(i, None, None, None, None if i % 2 else "") for i in range(100, 104)] + [(None, "b", "en", 1, "no\nid"), (None, "b", "en", 1, "no\nid"), (7, "b", "x", 2, "same"), (7, "b", "x", 2, "same"), (7, "b", "x", 2, "other\n"), (-3, "é", "x", -2, "ünï\n" * 9), (8, "", "x", 0, "\n"), (9, "lone", "x", 1, "y" * 300_000 + "\n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert asked(docs.withColumns({c: F.lit("clash") for c in ("tree", "idx", "leaf", "n", "salt", "part", "at", "block", "root", "changed", "path")})) == want
    assert {r[-1] for r in want} == {True, False}
    assert asked(docs.limit(0)) == []
    one = rows[-1:]
    assert asked(spark.createDataFrame(one, SCHEMA)) == plain(one)
    assert all(r.verified for r in merkle.manifest(docs).collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_many_blocks_and_many_sources(spark, levels):
    """Small blocks make several passes, both of a hot source and of the tree over sources."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 37}", "en", i, f"text\n{i}") for i in range(330)]
    assert asked(spark.createDataFrame(rows, SCHEMA).repartition(5), levels=levels) == plain(rows)


def test_absent_columns_count_as_null(spark):
    docs = spark.createDataFrame([(1, "a\n"), (2, "b")], "doc_id long, text string")
    assert asked(docs) == plain([(1, None, None, None, "a\n"), (2, None, None, None, "b")])
