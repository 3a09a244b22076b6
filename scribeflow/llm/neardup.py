"""Operator 2: near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets fall together
by digest; one representative of each set goes on. Each has a sketch of
minwise tokens. Independent trees branch the representatives: at the root by
two tokens a tree (as many trees as reach RECALL), below by tokens chosen from the node's own hash, with
1 / similarity branches in expectation, so that a pair at the threshold keeps
one common path in expectation while others part. A node small enough is
compared exhaustively: by sketches first, with a margin of several standard
deviations, then exactly on the full sets. A large node is also compared in
blocks that share a pivot; once nearly all its documents agree with the pivot
on 61 of 64 tokens (or the depth is used up) its remaining documents are
compared with all blocks, and it isn't branched further. Documents of different
blocks that agree with the pivot so far meet through it. A document at the
threshold agrees so far with the pivot by chance once in 100 (at 0.85) or 2,000
(at 0.8): if it is below, its links are left to the other trees, which have
pivots of their own.

What sketches link in a node is a group, with a spanning tree of its closest
links. First only the trees' links are confirmed on full sets, one for each
document. Where all hold, the group is one component; in the other groups every
pair is compared, which gives a star for each exactly linked component, never all
pairs. So output stays linear in the rows. Groups are bounded in documents and
in bytes. Components of these stars over the cluster give each document's
group. Once a node is known to be large, its rows are dealt over tasks by salt.
The joins that find a node's size and a row's class hold narrow columns and
have a side that was aggregated first, so adaptive execution can split a key
that very many rows share. All tables but the result are removed at the end.

Defined cases: null or blank texts have an empty set and are linked with
nothing; fewer words than a shingle make one shingle of all of them; equal
texts are one group; rows that repeat an id count as one document; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars, sieve
from scribeflow.llm.components import components
from scribeflow.runtime import Scratch, tasks_for, written

#: Minwise tokens in a sketch; a path's used tokens fit a 64-bit mask.
TOKENS = 64
#: The probability at least with which a pair at the threshold keeps a common path through DEPTH levels.
RECALL = 0.99
#: A node of at most this many documents is compared exhaustively.
LEAF = 2048
BLOCK = 1024
DEPTH = 8
#: Shingles of texts that are compared at once in a task: more documents, or longer ones, are compared by pairs of blocks.
BULK = 1 << 20
#: Links of one document that a task confirms, about.
FAN = 256
#: Tasks over which the rows of a large node are dealt.
SALTS = 32
_CHARS = 500_000
_U = np.uint64


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = chars.words(texts)
    n = len(h)
    with np.errstate(over="ignore"):
        odd = chars.mix(np.arange(1, k + 1, dtype=np.uint64) * chars.GOLD) | _U(1)
        s = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            s += h[j : n - k + 1 + j] * odd[j]
        s = chars.mix(s)
        out = []
        for i in range(len(texts)):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:
                short = np.array([np.sum(h[a:b] * odd[: b - a]) + _U(b - a)], np.uint64)
                out.append(chars.mix(short ^ _U(0xA5A5)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minwise(s: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit minwise tokens of a non-empty set."""
    with np.errstate(over="ignore"):
        a = chars.mix(np.arange(101, 101 + TOKENS, dtype=np.uint64) * chars.GOLD) | _U(1)
        low = np.full(TOKENS, ~_U(0))
        for i in range(0, len(s), 1024):
            np.minimum(low, (a[:, None] * s[None, i : i + 1024]).min(axis=1), out=low)
        return (chars.mix(low) >> _U(32)).astype(np.uint32)


def features(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, key (digest of the set; null if empty), n (its size), sketch, mini (the sketch's low bytes)."""
    kind, out = arrow.schema(None, "doc_id long, key binary, n long, sketch binary, mini binary")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chars.blocks(texts, _CHARS):
                sets = shingle_sets(texts[i:j], k)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sketch = [minwise(s) if len(s) else None for s in sets]
                yield arrow.batch(out, b.column(0)[i:j], keys, [len(s) for s in sets], [x.tobytes() if x is not None else None for x in sketch], [x.astype(np.uint8).tobytes() if x is not None else None for x in sketch])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of each value of a column by which the partition is sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(column).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = b.slice(a, z - a)
            if i == 0 and held and held[0].column(column)[0].as_py() == keys[0]:
                held.append(part)
                continue
            if held:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _grouped(df: DataFrame, key: str, run: Callable, ddl: str, tasks: int) -> DataFrame:
    """run(rows of one key) -> columns, for keys of bounded size."""
    kind, out = arrow.schema(None, ddl)

    @arrow.settled
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in out]
        for rows in _runs(batches):
            got = run(rows)
            if got is not None:
                for h, c in zip(held, got, strict=True):
                    h.extend(c)
            if len(held[0]) > 20_000:
                yield arrow.batch(out, *held)
                held = [[] for _ in out]
        yield arrow.batch(out, *held)

    return df.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(each, kind)


def _linked(links: np.ndarray) -> np.ndarray:
    """The smallest row number that each row reaches in a symmetric boolean matrix."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            seen = links[i].copy()
            seen[i] = True
            new = seen.copy()
            while new.any():
                reach = links[new].any(axis=0) & ~seen
                seen |= reach
                new = reach
            root[seen] = i
    return root


def _spanning_forest(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a symmetric matrix (0: no link) the first row of its component, and its neighbour in a tree of the
    heaviest links (itself for the first); of equal links the one to the row that joined first counts."""
    n = len(weight)
    first, parent = np.full(n, -1), np.arange(n)
    for start in range(n):
        if first[start] >= 0:
            continue
        first[start] = start
        best, via = np.where(first < 0, weight[start], 0), np.full(n, start)
        while True:
            v = int(best.argmax())
            if not best[v]:
                break
            first[v], parent[v], best[v] = start, via[v], 0
            more = (weight[v] > best) & (first < 0)
            best[more], via[more] = weight[v][more], v
    return first, parent


def _similar_groups(similarity: float, slack: float) -> Callable:
    least = int(np.ceil((similarity - slack) * TOKENS))  # low bytes agree by chance too, which only adds pairs to verify

    def run(rows: pa.RecordBatch):
        if rows.num_rows < 2:
            return None
        docs = rows.column(1).to_numpy()
        docs, first = np.unique(docs, return_index=True)
        if len(docs) < 2:
            return None
        n = rows.column(2).to_numpy()[first].astype(float)
        sketch = np.frombuffer(b"".join(rows.column(3).take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, TOKENS)
        weight = np.empty((len(docs), len(docs)), np.uint8)
        for a in range(0, len(docs), 256):  # a strip at a time
            part = sketch[a : a + 256]
            same = np.zeros((len(part), len(docs)), np.uint8)
            for i in range(TOKENS):
                same += part[:, i, None] == sketch[None, :, i]
            small, large = np.minimum(n[a : a + 256, None], n[None]), np.maximum(n[a : a + 256, None], n[None])
            weight[a : a + 256] = np.where((same >= least) & (small >= similarity * large - 1e-9), same, 0)
        np.fill_diagonal(weight, 0)
        linked = np.flatnonzero(weight.any(axis=1))
        docs, weight = docs[linked], weight[np.ix_(linked, linked)]
        root, parent = _spanning_forest(weight)
        groups, members, parents = [], [], []
        for g in np.unique(root):
            own = np.flatnonzero(root == g)
            name = int.from_bytes(hashlib.blake2b(docs[own].tobytes(), digest_size=8).digest(), "little", signed=True)
            groups += [name] * len(own)
            members += docs[own].tolist()
            parents += docs[parent[own]].tolist()
        return groups, members, parents

    return run


def exact_links(sets: list[np.ndarray], parts: tuple[int, int]) -> np.ndarray:
    """Which pairs have parts[1] * intersection >= parts[0] * union. sets: sorted distinct hashes."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((m, m), np.float32)  # counts below 2**24 are exact
    # strips of the hash range, so that very many or very long sets take bounded memory
    strips = max(1, int(sizes.sum()) >> 20)
    edges = np.array([(1 << 64) * k // strips for k in range(1, strips)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    for k in range(strips):
        held = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        _, column, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        row = np.repeat(np.arange(m), [len(s) for s in held])
        use = shared[column]
        row, col = row[use], place[column[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        total = int(shared.sum())
        for a in range(0, total, 2048):
            i, j = np.searchsorted(col, [a, a + 2048])
            x = np.zeros((m, min(2048, total - a)), np.float32)
            x[row[i:j], col[i:j] - a] = 1
            both += x @ x.T
    out = np.empty((m, m), bool)
    for i in range(m):
        inter = both[i].astype(np.int64)
        out[i] = parts[1] * inter >= parts[0] * (sizes[i] + sizes - inter)
    return out


def _exact_stars(k: int, parts: tuple[int, int]) -> Callable:
    def run(rows: pa.RecordBatch):
        if rows.num_rows < 2:
            return None
        docs = rows.column(1).to_numpy()
        texts = rows.column(2).to_pylist()
        sets = [s for i, j in chars.blocks(texts, _CHARS) for s in shingle_sets(texts[i:j], k)]
        order = np.argsort(docs, kind="stable")
        root = _linked(exact_links([sets[i] for i in order], parts))
        docs = docs[order]
        own = root != np.arange(len(docs))
        return docs[root[own]].tolist(), docs[own].tolist()

    return run


def _confirmed(tree: DataFrame, reps: DataFrame, active: DataFrame, k: int, parts: tuple[int, int]) -> DataFrame:
    """parent, child, ok of the links of spanning trees (class, parent): whether their full sets are as similar as asked for.

    A parent's children are dealt in parts of about FAN, each with a copy of the parent, and checked one by one.
    """
    spark = tree.sparkSession
    pairs = tree.where("class <> parent").select("parent", F.col("class").alias("child")).distinct()
    fan = pairs.groupBy("parent").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    part = lambda p: F.xxhash64("parent", p.cast("long")).alias("grp")
    heads = fan.select("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")).select(part(F.col("p")), F.lit(0).alias("role"), "parent", F.col("parent").alias("class"))
    children = pairs.join(fan, "parent").select(part(F.pmod(F.xxhash64("child"), F.col("parts"))), F.lit(1).alias("role"), "parent", F.col("child").alias("class"))
    rows = heads.unionByName(children).join(reps.select("class", "key", "doc"), "class").join(active, "doc")
    rows = rows.select("grp", "role", "parent", "class", "key", "text")
    kind, out = arrow.schema(None, "parent long, child long, ok boolean")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple = (None, None)
        for b in batches:
            groups, roles, parents, classes, keys, texts = (c.to_pylist() for c in b.columns)
            found: list[tuple] = []
            for i, j in chars.blocks(texts, _CHARS):
                for r, s in enumerate(shingle_sets(texts[i:j], k), i):
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != keys[r]:
                        continue  # another text of the same id
                    if not roles[r]:
                        head = groups[r], s
                    elif head[0] == groups[r]:
                        inter = len(np.intersect1d(head[1], s, assume_unique=True))
                        found.append((parents[r], classes[r], parts[1] * inter >= parts[0] * (len(head[1]) + len(s) - inter)))
            yield arrow.batch(out, *([f[c] for f in found] for c in range(3)))

    tasks = tasks_for(spark, tree.count(), 20_000)
    return rows.repartition(tasks, "grp").sortWithinPartitions("grp", "role").mapInArrow(run, kind)


def missed(similarity: float, count: int) -> float:
    """The probability that a pair at the threshold has no common path after DEPTH levels of so many trees."""
    second, out = 1 / similarity - 1, 0.0
    for same in range(TOKENS + 1):  # tokens on which the two sketches agree; a path uses up those that it took
        ended = 0.0  # the pair has no common path left below a node that it shares
        for used in range(DEPTH, 0, -1):
            keeps = max(0, same - used) / (TOKENS - used)
            lost = 1 - keeps + keeps * ended
            ended = (1 - second) * lost + second * lost**2
        roots = sum(comb(same, r) * comb(TOKENS - same, 2 * count - r) * ended**r for r in range(2 * count + 1)) / comb(TOKENS, 2 * count)
        out += comb(TOKENS, same) * similarity**same * (1 - similarity) ** (TOKENS - same) * roots
    return out


def trees(similarity: float) -> int:
    """The least number of independent trees, each with two root branches, that reaches RECALL."""
    return next((n for n in range(1, TOKENS // 2) if missed(similarity, n) <= 1 - RECALL), TOKENS // 2)


def _root_paths(reps: DataFrame, similarity: float) -> DataFrame:
    kind, out = arrow.schema(None, "node long, used long, doc long")
    roots = 2 * trees(similarity)

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy()
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            for c in range(roots):
                with np.errstate(over="ignore"):
                    node = chars.mix(sketch[:, c].astype(np.uint64) + _U(c + 1) * chars.GOLD)
                yield arrow.batch(out, node.view(np.int64), np.full(len(docs), 1 << c), docs)

    return reps.select("doc", "sketch").mapInArrow(run, kind)


def _branches(rows: DataFrame, similarity: float) -> DataFrame:
    kind, out = arrow.schema(None, "node long, used long, doc long")
    second = _U(int((1 / similarity - 1) * 2**64))

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy().view(np.uint64)
            used = b.column(1).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS)
            with np.errstate(over="ignore"):
                order = chars.mix(node[:, None] + np.arange(7, 7 + TOKENS, dtype=np.uint64)[None] * chars.GOLD)
                order[(used[:, None] >> np.arange(TOKENS, dtype=np.uint64)[None]) & _U(1) == 1] = ~_U(0)
                best = np.argpartition(order, 2, axis=1)[:, :2]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(order, best, 1), axis=1), 1)
                more = chars.mix(node ^ _U(0x5DEECE66D)) < second
                for turn in (0, 1):
                    rows = np.arange(len(node)) if turn == 0 else np.flatnonzero(more)
                    c = best[rows, turn]
                    child = chars.mix(node[rows] * chars.M1 + chars.mix(sketch[rows, c].astype(np.uint64) + c.astype(np.uint64) * chars.GOLD))
                    yield arrow.batch(out, child.view(np.int64), (used[rows] | (_U(1) << c.astype(np.uint64))).view(np.int64), b.column(2).take(pa.array(rows)))

    return rows.select("node", "used", "doc", "sketch").mapInArrow(run, kind)


def _dealt(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the columns of nodes (one row each): a node's rows are dealt over SALTS tasks, and its row goes to each."""
    salt = F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(SALTS)).cast("int")
    each = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(each, ["node", "_salt"]).drop("_salt")


def _near_pivot(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """rows with near: whether the sketch agrees with the pivot's almost everywhere."""
    kind, out = arrow.schema(None, "node long, used long, doc long, n long, mini binary, pivot long, size long, near boolean")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, TOKENS) for c in (4, 7))
            yield arrow.batch(out, *b.columns[:7], (x == y).mean(axis=1) >= least)

    pivots = rows.where("doc = pivot").select("node", F.col("mini").alias("other")).dropDuplicates(["node"])
    own = _dealt(rows.select("node", "used", "doc", "n", "mini", "pivot", "size"), pivots)
    return own.select("node", "used", "doc", "n", "mini", "pivot", "size", "other").mapInArrow(run, kind)


def _compared(reps: DataFrame, similarity: float, scratch: Scratch) -> list[DataFrame]:
    """Tables (grp, doc, n, mini) of bounded groups whose members are to be compared."""
    groups = []
    rows = _root_paths(reps, similarity)
    for level in range(DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("doc").alias("pivot")).where("size > 1")
        live = rows.join(sizes, "node").join(reps.select("doc", "n", "mini"), "doc")
        live = scratch.written(live.select("node", "used", "doc", "n", "mini", "pivot", "size"), "paths")
        groups.append(live.where(F.col("size") <= LEAF).select(F.col("node").alias("grp"), "doc", "n", "mini"))
        large = live.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        large = scratch.written(_near_pivot(large), "pivots")
        far = large.groupBy("node").agg(F.count_if(~F.col("near")).alias("far"))
        large = _dealt(large, far).withColumns({
            "blocks": F.ceil(F.col("size") / BLOCK), "far_blocks": F.greatest(F.lit(1), F.ceil(F.col("far") / BLOCK)),
            "ends": (F.col("far") <= BLOCK) | F.lit(level == DEPTH), "salt": F.xxhash64("doc", F.lit(11)),
        })
        block, far_block = F.pmod("salt", "blocks"), F.pmod(F.shiftright("salt", 20), F.col("far_blocks"))
        all_blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        name = lambda i, j: F.xxhash64("node", i.cast("long"), j.cast("long"))
        none = F.array().cast("array<bigint>")
        ended = F.when(F.col("ends"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("far_blocks") - 1), lambda j: name(block, j))).otherwise(F.array(name(block, F.lit(-1))))
        rest = F.when(F.col("ends") & ~F.col("near"), F.transform(all_blocks, lambda i: name(i, far_block))).otherwise(none)
        shared = F.when(F.col("doc") == F.col("pivot"), F.transform(all_blocks, lambda i: name(i, F.when(F.col("ends"), 0).otherwise(-1)))).otherwise(none)
        groups.append(large.select(F.explode(F.array_distinct(F.concat(ended, rest, shared))).alias("grp"), "doc", "n", "mini"))
        if level < DEPTH:
            rows = scratch.written(_branches(large.where(~F.col("ends")).select("node", "used", "doc").join(reps.select("doc", "sketch"), "doc"), similarity), "branches")
    return groups


def _bounded(alike: DataFrame) -> DataFrame:
    """alike (grp, doc, n) with groups of more than BULK shingles cut into blocks: each pair of blocks is a group.

    So what a task holds is bounded in bytes too, and each pair of documents still meets.
    """
    before = F.sum("n").over(W.partitionBy("grp").orderBy("doc").rowsBetween(W.unboundedPreceding, -1))  # of at most about LEAF rows
    rows = alike.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BULK))
    rows = rows.withColumn("blocks", F.max("block").over(W.partitionBy("grp")) + 1)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (j != F.col("block")) | (F.col("blocks") == 1))
    pair = rows.select("grp", "doc", "block", F.explode(others).alias("other"))
    return pair.select(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("grp"), "doc")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), text: str = "text", slack: float = 0.18) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; similarity is a fraction (parts, of)."""
    spark, level = docs.sparkSession, similarity[0] / similarity[1]
    scratch, own_tables = Scratch(spark), Scratch(spark)
    found = own_tables.written(features(docs, k, text), "sets")
    whole = found.where("key IS NOT NULL AND doc_id IS NOT NULL")
    reps = whole.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini"))
    reps = own_tables.written(reps.withColumn("class", F.xxhash64("key")), "classes")
    groups = None
    for g in _compared(reps.select(F.col("class").alias("doc"), "n", "sketch", "mini"), level, scratch):
        groups = g if groups is None else groups.unionByName(g)
    tasks = tasks_for(spark, reps.count() * 2 * trees(level), 2_000_000)
    tree = own_tables.written(_grouped(groups, "grp", _similar_groups(level, slack), "grp long, class long, parent long", tasks).distinct(), "trees")
    alike = own_tables.written(tree.join(reps.select("class", "doc", "n"), "class").groupBy("grp", "doc").agg(F.max("n").alias("n")), "alike")
    scratch.clear()
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    active, _ = sieve.parted(own, F.col("doc"), alike.select("doc"))
    again = whole.groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min("key") != F.max("key")).alias("varied")).where("rows > 1")
    again = own_tables.written(again, "again")
    if not again.isEmpty():  # of rows that repeat an id and a text one goes on
        some, single = sieve.parted(active, F.col("doc"), again.select("doc_id"))
        active = single.unionByName(some.dropDuplicates(["doc", "text"]))
    # texts travel, not sets: they compress, and sets are made where they are compared
    links = own_tables.written(_confirmed(tree.select("class", "parent"), reps, active, k, similarity), "links")
    of = lambda c, name: reps.select(F.col("class").alias(c), F.col("doc").alias(name))
    edges = links.where("ok").join(of("parent", "u"), "parent").join(of("child", "v"), "child").select("u", "v")
    # a group whose tree holds is one component, whatever its other pairs are; the others are compared whole
    open_ = tree.join(links.where("NOT ok").select("parent", F.col("child").alias("class")), ["parent", "class"], "left_semi").select("grp").distinct()
    unsure = own_tables.written(alike.join(open_, "grp", "left_semi"), "unsure")
    full = _bounded(unsure).join(active, "doc").select("grp", "doc", "text")
    edges = edges.unionByName(_grouped(full, "grp", _exact_stars(k, similarity), "u long, v long", tasks_for(spark, unsure.count(), 20_000)))
    if not again.isEmpty():  # an id with several texts is one document
        varied = whole.join(again.where("varied").select("doc_id"), "doc_id").select("doc_id", "key").distinct()
        edges = edges.unionByName(varied.join(reps.select("key", "doc"), "key").select(F.col("doc_id").alias("u"), F.col("doc").alias("v")))
    roots = components(edges)
    unmatched = F.concat(F.lit("-").cast("binary"), F.col("doc_id").cast("string").cast("binary"))  # of no class: dealt over all tasks
    out = (
        found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("key", unmatched).alias("key"))
        .join(reps.select("key", "doc"), "key", "left")
        .join(roots, F.col("doc") == F.col("vertex"), "left")
        .withColumn("component_id", F.coalesce("component", "doc", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )
    out = written(out, "groups")
    own_tables.clear()
    return out
