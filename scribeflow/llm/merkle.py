"""Operator 12: a Merkle manifest of a dataset, with a proof for each row.

Each row is a leaf; the leaves of a source, by id, form a tree in which three
consecutive nodes have a parent, and the sources' roots form one more such tree.

Trees are cut into aligned blocks of 3^LEVELS nodes. In a block the proofs come
leaf by leaf from a Merkle traversal: for each level a treehash stack builds
the siblings that will be needed next, a leaf at a time, and each step's work
goes to the stacks with the lowest unfinished node, so besides the block's
digests a task holds a number of nodes logarithmic in the block. A node left of
the path is known once its last leaf has passed. The blocks' roots are the
leaves of the next trees, cut and climbed alike, until each tree has one root;
the path above a block is shared by its leaves and appended to theirs.

Leaves are numbered by range partitions whose order ends in a row number, so a
source or id that holds a third of all rows is spread; what is shuffled are
digests, never texts. No block has more than 3^LEVELS rows.

Defined cases: null columns, absent columns among LEAF, and null sources count
as null (`-`); rows of one source and id are ordered by digest (equal ones are
interchangeable), null ids first; repeated rows are a leaf each; a lone leaf is
its tree's root and its path is empty there; rows without id are not tampered
with; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.llm import arrow
from scribeflow.runtime import Scratch, tasks_for, written

#: Children of a node, and the levels that one task climbs: blocks of 729 nodes.
ARITY, LEVELS = 3, 6
#: The columns that a leaf's digest covers, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

Path = list[tuple[list[str], list[str]]]


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Subtree:
    """Treehash: the node at a level and place over leaves, built a leaf at a time."""

    def __init__(self, leaves: list[str], level: int, place: int):
        self.leaves, self.level = leaves, level
        self.at = place * ARITY**level
        self.end = min(len(leaves), self.at + ARITY**level)
        self.held: list[list[str]] = [[] for _ in range(level)]
        self.node: str | None = None

    def low(self) -> int:
        """The level of the lowest unfinished node."""
        return next((i for i, run in enumerate(self.held) if run), self.level)

    def step(self) -> None:
        node, self.at = self.leaves[self.at], self.at + 1
        for run in self.held:
            run.append(node)
            if len(run) < ARITY and self.at < self.end:
                return
            node = digest(run)
            run.clear()
        self.node = node


class Ahead:
    """The nodes right of the first child of a parent at a level, to be ready when the path gets there."""

    def __init__(self, leaves: list[str], level: int, parent: int):
        places = range(ARITY * parent + 1, ARITY * (parent + 1))
        self.todo = [Subtree(leaves, level, p) for p in places if p * ARITY**level < len(leaves)]
        self.done: list[str] = []

    def low(self) -> int | None:
        return self.todo[0].low() if self.todo else None

    def step(self) -> None:
        self.todo[0].step()
        if self.todo[0].node is not None:
            self.done.append(self.todo.pop(0).node)

    def finish(self) -> list[str]:
        while self.todo:
            self.step()
        return self.done


def levels_of(n: int) -> int:
    """Levels above n nodes."""
    up = 0
    while ARITY**up < n:
        up += 1
    return up


def traversal(leaves: list[str], levels: int, held: list | None = None) -> Iterator[Path]:
    """For each leaf in turn its siblings (left of it, right of it) at each of levels levels. held: gets the nodes kept."""
    left: list[list[str]] = [[] for _ in range(levels)]
    right = [Ahead(leaves, h, 0).finish() for h in range(levels)]
    ahead = [Ahead(leaves, h, 1) for h in range(levels)]
    for i, node in enumerate(leaves):
        yield [(left[h][:], right[h][:]) for h in range(levels)]
        if held is not None:
            held.append(sum(map(len, left)) + sum(map(len, right)) + sum(len(a.done) + sum(len(r) for s in a.todo for r in s.held) for a in ahead))
        for _ in range(levels):  # a step for each level, where the lowest unfinished node is
            low = [(a.low(), h) for h, a in enumerate(ahead) if a.todo]
            if not low:
                break
            ahead[min(low)[1]].step()
        for h in range(levels):
            if (i + 1) % ARITY ** (h + 1):
                left[h].append(node)
                del right[h][:1]
                break
            node = digest([*left[h], node])
            parent = (i + 1) // ARITY ** (h + 1)
            left[h], right[h], ahead[h] = [], ahead[h].finish(), Ahead(leaves, h, parent + 1)


def folded(node: str, path: Path) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


def root_of(leaves: list[str], levels: int) -> str:
    one = Subtree(leaves, levels, 0)
    while one.node is None:
        one.step()
    return one.node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest (bytes) of a leaf with these fields."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch, parts: int) -> DataFrame:
    """rows with idx (from 0 within their tree, by order, ties by row) and n (rows of the tree)."""
    by = [tree, *order, "salt"]
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    # range bounds are sampled: the counts below must be those of the rows that are returned
    placed = scratch.written(placed.drop("salt").withColumn("at", at).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "placed")
    runs = placed.groupBy(tree, "part").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    before = W.partitionBy(tree).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = runs.select(tree, "part", (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(W.partitionBy(tree)).alias("n"))
    return placed.join(starts, [tree, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


_PATH = "array<struct<l: array<string>, r: array<string>>>"


def _block(levels: int) -> Column:
    return F.expr(f"idx div {ARITY**levels}")


def _above(levels: int) -> Column:
    """How many nodes a tree of n has levels higher."""
    return F.expr(f"(n + {ARITY**levels - 1}) div {ARITY**levels}")


def _nodes(table: pa.Table, levels: int) -> tuple[pa.Table, int]:
    """A block's rows by idx, and the levels that its task climbs: all of a tree of one block, else those of the block."""
    return table.sort_by("idx"), min(levels, levels_of(table.column("n")[0].as_py()))


def _roots(leaves: DataFrame, levels: int) -> DataFrame:
    """tree, block, root, n of each block of leaves (tree, idx, leaf, n)."""
    kind, out = arrow.schema(None, "tree string, block long, root string, n long")

    def run(table: pa.Table) -> pa.Table:
        table, up = _nodes(table, levels)
        one = table.slice(0, 1)
        root = root_of([x.hex() for x in table.column("leaf").to_pylist()], up)
        return pa.table([one.column("tree").combine_chunks(), pa.array([one.column("idx")[0].as_py() // ARITY**levels], pa.int64()), pa.array([root]), one.column("n").combine_chunks()], schema=out)

    return leaves.select("tree", "idx", "leaf", "n", _block(levels).alias("block")).groupBy("tree", "block").applyInArrow(run, kind)


def _climbed(nodes: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """tree, idx, path and root (of the tree) of nodes (tree, idx, node, n)."""
    kind, out = arrow.schema(None, f"tree string, idx long, n long, path {_PATH}, root string")

    def run(table: pa.Table) -> pa.Table:
        table, up = _nodes(table, levels)
        leaves = table.column("node").to_pylist()
        paths = [[{"l": a, "r": b} for a, b in p] for p in traversal(leaves, up)]
        columns = [table.column("tree").combine_chunks(), table.column("idx").combine_chunks(), table.column("n").combine_chunks(), pa.array(paths, out.field("path").type), pa.array([root_of(leaves, up)] * len(leaves))]
        return pa.table(columns, schema=out)

    passes = []
    while True:
        passes.append(scratch.written(nodes.select("tree", "idx", "node", "n", _block(levels).alias("block")).groupBy("tree", "block").applyInArrow(run, kind), "climbed"))
        more = passes[-1].where(f"n > {ARITY**levels} AND idx % {ARITY**levels} = 0")
        if more.isEmpty():
            break
        nodes = more.select("tree", _block(levels).alias("idx"), F.col("root").alias("node"), _above(levels).alias("n"))
    up = passes.pop().select("tree", "idx", "path", "root")
    for below in reversed(passes):
        above = up.select("tree", F.col("idx").alias("block"), F.col("path").alias("more"), F.col("root").alias("top"))
        joined = below.withColumn("block", _block(levels)).join(above, ["tree", "block"], "left")
        more = F.coalesce("more", F.array().cast(_PATH))
        up = scratch.written(joined.select("tree", "idx", F.concat("path", more).alias("path"), F.coalesce("top", "root").alias("root")), "climbed")
    return up


def _proofs(leaves: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """The result's rows: each block of leaves meets the path that they share."""
    kind, out = arrow.schema(None, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        table, up = _nodes(table, levels)
        own = [x.hex() for x in table.column("leaf").to_pylist()]
        changed = [x and x.hex() for x in table.column("changed").to_pylist()]
        above = [(p["l"], p["r"]) for p in shared.column("path")[0].as_py()]
        tail = "".join(x for a, b in above for x in [*a, *b]).encode()
        subroot, root = shared.column("subroot")[0].as_py(), shared.column("root")[0].as_py()
        base = root_of(own, up)
        known = {base: folded(base, above)}  # where leaves that weren't changed meet
        proofs, roots = [], []
        for leaf, other, path in zip(own, changed, traversal(own, up), strict=True):
            proof = hashlib.sha256("".join(x for a, b in path for x in [*a, *b]).encode())
            proof.update(tail)
            proofs.append(proof.hexdigest())
            top = folded(other or leaf, path)
            roots.append(known.get(top) or folded(top, above))
        columns = [table.column("doc_id").combine_chunks(), own, [subroot] * len(own), [root] * len(own), proofs, roots, [r == root for r in roots]]
        return pa.Table.from_batches([arrow.batch(out, *columns)])

    a = leaves.withColumn("block", _block(levels)).groupBy("tree", "block")
    return a.cogroup(upper.groupBy("tree", "block")).applyInArrow(run, kind)


def manifest(docs: DataFrame, changed: Column | None = None, tampered: dict[str, Column] | None = None, order: str = "doc_id", tree: str = "source", levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs.

    Where changed holds, the fold starts from the leaf with the columns in
    tampered in place of its own; leaf, roots and siblings are of docs as it is.
    """
    scratch = Scratch(docs.sparkSession)
    have = {c: F.col(c) if c in docs.columns else F.lit(None) for c in LEAF}
    other = leaf_digest([(tampered or {}).get(c, have[c]) for c in LEAF])
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0")) if tree in docs.columns else F.lit("0")  # null first, then bytewise
    leaves = docs.select(name.alias("tree"), F.col(order).cast("long").alias("doc_id"), leaf_digest(list(have.values())).alias("leaf"), (F.when(changed, other) if changed is not None else F.lit(None).cast("binary")).alias("changed"))
    leaves = scratch.written(leaves, "leaves")
    leaves = scratch.written(numbered(leaves, "tree", ["doc_id", "leaf"], scratch, tasks_for(docs.sparkSession, leaves.count(), 1_000_000)), "numbered")
    blocks = scratch.written(_roots(leaves, levels), "blocks")
    cut = blocks.where(f"n > {ARITY**levels}").select("tree", F.col("block").alias("idx"), F.col("root").alias("node"), _above(levels).alias("n"))
    within = _climbed(cut, scratch, levels)
    subroots = blocks.where(f"n <= {ARITY**levels}").select("tree", "root").unionByName(within.where("idx = 0").select("tree", "root"))
    trees = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), "tree", ["name"], scratch, 1)
    trees = scratch.written(trees, "trees")
    top = _climbed(trees, scratch, levels).select("idx", F.col("path").alias("last"), F.col("root").alias("root"))
    tops = trees.select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "idx").join(top, "idx").drop("idx")
    paths = within.select("tree", F.col("idx").alias("block"), "path")
    upper = blocks.select("tree", "block").join(paths, ["tree", "block"], "left").join(tops, "tree")
    upper = upper.select("tree", "block", F.concat(F.coalesce("path", F.array().cast(_PATH)), "last").alias("path"), "subroot", "root")
    out = written(_proofs(leaves, scratch.written(upper, "upper"), levels), "manifest")
    scratch.clear()
    return out
