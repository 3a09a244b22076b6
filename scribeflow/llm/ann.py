"""Operator 5: approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors are one row, which keeps the smallest ids of its copies, as many
as an answer can hold; rows of one direction in a shard are one node (a heap
of copies would link to itself alone).
Nodes fall to shards of bounded size by hash. Within a shard the graph grows
in doubling batches: a greedy beam search on the graph so far proposes each
new node's neighbours, relaxed distance pruning keeps diverse ones, and the
links back are pruned alike. Beam searches of many nodes advance together as
array operations. Each shard's graph is a file in the shared folder. A task
that holds a block of queries loads the shards in turn, beam-searches each and
keeps the best k so far, so rows never exceed the queries and their answers;
scores are computed in double precision on the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite
components (and null ids) take no part; vectors of different lengths have no
cosine, so each length is searched among its own (by an index each, so a
column should hold few lengths); rows that repeat an id and a vector count once, and a query id with several vectors is
asked with each; ties go to the smaller id; with fewer
candidates than asked for, all are returned; components whose squares overflow
or underflow are scaled by powers of two, which is exact; columns other than
the id and the vector are never read; empty tables give empty results.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars
from scribeflow.runtime import cut_lineage, fresh_path

SHARD_ROWS = 8192
DEGREE = 32
BUILD_BEAM = 48
QUERY_BEAM = 160
RELAXED = 1.2
QUERY_BLOCK = 4096
FOUND = "query_id long, rank int, vec_id long, score double"


def beam_search(x: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int, lanes: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest nodes that greedy search finds for each query: ids (-1: none) and squared distances, nearest first.

    x: nodes; links: out-neighbours of each node (-1: none).
    """
    outs = [_beam(x, links, entry, queries[i : i + lanes], beam) for i in range(0, len(queries), lanes)]
    return np.concatenate([a for a, _ in outs]), np.concatenate([b for _, b in outs])


def _beam(x, links, entry, q, beam):
    n, far = len(q), np.float32(np.inf)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), far, np.float32)
    done = np.zeros((n, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = ((q - x[entry]) ** 2).sum(1)
    seen = np.zeros((n, len(x)), bool)
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), far, dist[live])
        best = open_.argmin(1)
        go = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        near = links[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows = np.broadcast_to(live[:, None], near.shape)
        seen[rows[fresh], near[fresh]] = True
        d = np.full(near.shape, far, np.float32)
        a, b = rows[fresh], near[fresh]
        diff = x[b] - q[a]
        d[fresh] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_d, all_i, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Diverse out-neighbours of each node from its candidates (-1: none): nearest first, dropping those that a kept one covers."""
    c = np.where(candidates == nodes[:, None], -1, candidates)
    c = np.sort(c, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    safe = np.maximum(c, 0)
    y = x[safe]
    d = ((y - x[nodes][:, None]) ** 2).sum(2)
    d[c < 0] = np.inf
    between = (y * y).sum(2)
    between = between[:, :, None] + between[:, None] - 2 * np.matmul(y, y.transpose(0, 2, 1))
    left = d.copy()
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = c[rows[some], best[some]]
        left[rows[some], best[some]] = np.inf
        covered = relaxed * between[rows, best] <= d
        left[some] = np.where(covered[some], np.inf, left[some])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> tuple[np.ndarray, int]:
    """Out-neighbours of each row of x and the entry node."""
    n = len(x)
    links = np.full((n, degree), -1, np.int32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if n else 0
    order = chars.mix(np.arange(n, dtype=np.uint64)).argsort()
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int64)
    at = 1
    while at < n:
        new = order[at : min(n, 2 * at, at + 1024)]
        found, _ = beam_search(x, links, entry, x[new], beam)
        # the new nodes of a batch don't know each other yet: their nearest among themselves join the proposals
        inner = x[new] @ x[new].T * -2 + (x[new] ** 2).sum(1)[None]
        own = new[np.argpartition(inner, min(12, len(new) - 1), axis=1)[:, :13]].astype(np.int32)
        links[new] = robust_prune(x, new, np.concatenate([found, own], 1), degree, relaxed)
        heads, tails = np.repeat(new, degree), links[new].reshape(-1)
        heads, tails = heads[tails >= 0], tails[tails >= 0]
        by = np.argsort(tails, kind="stable")
        heads, tails = heads[by], tails[by]
        touched, first, count = np.unique(tails, return_index=True, return_counts=True)
        for a in range(0, len(touched), 512):
            t, f, m = touched[a : a + 512], first[a : a + 512], count[a : a + 512]
            back = np.full((len(t), int(m.max())), -1, np.int32)
            lane = np.repeat(np.arange(len(t)), m)
            place = np.arange(len(lane)) - np.repeat(np.cumsum(m) - m, m)
            back[lane, place] = heads[f[0] : f[0] + len(lane)]
            for w in range(0, back.shape[1], 64):  # a node that very many link to takes them in turns
                links[t] = robust_prune(x, t, np.concatenate([links[t], back[:, w : w + 64]], 1), degree, relaxed)
        at += len(new)
    return links, entry


def _usable(vectors: DataFrame, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two so that their largest component is between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the largest scores, ties to the smaller id: query, vec, score, rank from 1."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
    keep = rank <= k
    return query[keep], vec[keep], score[keep], rank[keep]


def packed_shard(x: np.ndarray, ids: list[list[int]]) -> tuple:
    """What a query needs of a shard: its graph, and the rows and ids of each node. Rows of one direction are one node."""
    x = scaled(x)
    norm = np.linalg.norm(x, axis=1)
    unit, node = np.unique((x / norm[:, None]).astype(np.float32), axis=0, return_inverse=True)
    order = np.argsort(node, kind="stable")
    ids = [ids[i] for i in order]
    rows_at = np.searchsorted(node[order], np.arange(len(unit) + 1))
    return unit, *build(unit), x[order], norm[order], rows_at, np.concatenate(ids), np.cumsum([0, *map(len, ids)])


def _answers(shard: tuple, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and scores of at least the k best other rows that a shard's graph gives for each query."""
    unit, links, entry, x, norm, rows_at, ids, ids_at = shard
    q_norm = np.linalg.norm(q, axis=1)
    near, _ = beam_search(unit, links, entry, (q / q_norm[:, None]).astype(np.float32), max(beam, k + 2))
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, nodes in enumerate(near):
        nodes = nodes[nodes >= 0]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(rows_at[nodes], rows_at[nodes + 1], strict=True)])
        score = x[rows] @ q[i] / (norm[rows] * q_norm[i])
        least = -np.partition(-score, min(k, len(score) - 1))[min(k, len(score) - 1)]
        best = np.flatnonzero(score >= least)  # k + 1 rows, and all that tie with the last
        copies = ids_at[rows[best] + 1] - ids_at[rows[best]]
        vec = np.concatenate([ids[ids_at[r] : ids_at[r + 1]] for r in rows[best]])
        other = vec != own[i]
        out.append((np.full(int(other.sum()), i), vec[other], np.repeat(score[best], copies)[other]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row among all rows but its own id."""
    usable, asked = _usable(vectors, vec), _usable(queries, vec)
    widths = [r["w"] for r in asked.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]  # lengths of vectors: as a rule one
    parts = [_search_width(usable.where(F.size("v") == w), asked.where(F.size("v") == w).distinct(), k, shard_rows, beam, block) for w in widths]
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], FOUND)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_width(usable: DataFrame, asked: DataFrame, k: int, shard_rows: int, beam: int, block: int) -> DataFrame:
    """search among vectors of one length."""
    vectors = usable
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))  # each task keeps k + 1 ids a vector before the shuffle
    nodes = usable.distinct().withColumn("place", first).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut_lineage(nodes)
    shards = max(1, -(-nodes.count() // shard_rows))
    asked = cut_lineage(asked.select("vec_id", "v"))
    n = asked.count()
    # blocks of bounded size; few queries are spread so that no core idles
    blocks = max(1, -(-n // block), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 64)))
    folder = fresh_path(vectors.sparkSession, "graphs")
    shard_of = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(1)), F.lit(shards)).cast("int")
    index_kind, index_out = arrow.schema(None, "shard int, path string")

    def graph(rows: pa.Table) -> pa.Table:
        x = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1)
        packed = pickle.dumps(packed_shard(x, rows.column("ids").to_pylist()), protocol=5)
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}"  # a name of its own: what failed attempts leave is in no manifest
        with store.open_output_stream(path, compression=None) as f:
            f.write(packed)
        return pa.table([pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.array([path])], schema=index_out)

    made = nodes.withColumn("shard", shard_of).groupBy("shard").applyInArrow(graph, index_kind)
    paths = vectors.sparkSession.sparkContext.broadcast([path for _, path in sorted(map(tuple, made.collect()))])  # one name a shard
    found_kind, found_out = arrow.schema(None, FOUND)

    @arrow.settled
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a block of queries
        if not held:
            return
        own = np.concatenate([b.column(0).to_numpy() for b in held])
        q = scaled(np.concatenate([np.asarray(b.column(1).flatten()) for b in held]).reshape(len(own), -1))
        store, _ = pafs.FileSystem.from_uri(folder)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for path in paths.value:
            with store.open_input_file(path) as f:
                shard = pickle.loads(f.read())  # a graph of a bounded number of nodes
            *best, rank = _best(*(np.concatenate(c) for c in zip(best, _answers(shard, own, q, k, beam), strict=True)), k)
        if len(best[0]):
            yield arrow.batch(found_out, own[best[0]], rank.astype(np.int32), best[1], best[2])

    return asked.repartition(blocks, "vec_id").mapInArrow(answer, found_kind)
