"""Operator 8: benchmark passages in documents, by a random-walk embedding of edit distance.

Words (lower-cased, parted by white space and ASCII punctuation) are the
symbols, and single characters in scripts that set no blanks; both are called
words below. A passage matches where some run of a document's words is within
RATE * (its words) edits. The embedding of Chakraborty, Goldenberg and Koucky
walks along a window and at each step emits the symbol it stands on, then
advances or not by a random bit of step and symbol: few edits give few
differing steps. Bit-sampling keys take a few steps of the walk; several walks
reach the target recall. Windows start at every word and are as long as the
passages of a size class. What collides is verified by exact edit distance.

Before the walks, a lossless filter drops places where no passage can lie:
within e edits of n words at least n - 1 - 2e of its word pairs occur.

A passage of fewer than LEAST words is cut into one piece more than the edits
it may have, so that one piece is untouched; where a piece stands in a text,
the passage is verified. These short passages are found without loss.

Passages lie in blocks of about BLOCK_WORDS words in the shared folder; tasks
read a block and search all texts for it, so more passages take more passes and
no more memory, and neither the driver nor a broadcast holds them.

Defined cases: null and empty texts match nothing, nor do passages without a
word; very long texts are searched whole, in runs that overlap; of several matches
of a passage in a document the one with fewest edits, then the first, is
returned; equal passages match each; repeated document rows count once;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars, sieve
from scribeflow.runtime import fresh_path, written

RATE = 0.2
#: Passages of at least so many words are found by walks, shorter ones by their pieces.
LEAST = 8
#: Walks and sampled steps of each: a passage at the full edit rate is found with probability of about 0.99.
WALKS = 24
SAMPLED = 2
BLOCK_WORDS = 500_000
_SPAN = 18
_CHARS = 1_000_000
_U = np.uint64
_PAD = _U(0x0DDC0FFEE0DDF00D)


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    low, starts, lengths, at = chars.symbol_spans(texts)
    return chars.span_hashes(low, starts, lengths), at


def edits_allowed(n: int) -> int:
    return int(RATE * n + 1e-9)


def size_class(n: int) -> int:
    """Classes of passage sizes, each a quarter wider than the last."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1.25)))


def _pairs(h: np.ndarray) -> np.ndarray:
    return chars.mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:])


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    odd = chars.mix(np.arange(1, n + 1, dtype=np.uint64) * chars.GOLD) | _U(1)
    s = np.full(max(0, len(h) - n + 1), _U(n))
    for j in range(n):
        s += h[j : len(h) - n + 1 + j] * odd[j]
    return chars.mix(s)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits between item and a run of text, with the run's start and end: the first such end, the shortest run."""
    e, s, t = best_matches(item, text[None], np.array([len(text)]))
    return int(e[0]), int(s[0]), int(t[0])


def best_matches(item: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_match of item in each row of texts (cut to lengths). Sellers' recurrence, a row of the table at a time."""
    lanes, width = texts.shape
    col = np.arange(width + 1)
    # cost and start of the best run that ends at each place; packed so that minima prefer late starts (short runs)
    big = width + 2
    now = np.broadcast_to((big - 1 - col) + 0 * big, (lanes, width + 1)).astype(np.int64)
    for i, s in enumerate(item):
        up = now + big
        diagonal = now[:, :-1] + big * (texts != s)
        new = up
        new[:, 1:] = np.minimum(new[:, 1:], diagonal)
        # insertions along the row: a running minimum of value - column
        new = np.minimum.accumulate(new - col * big, axis=1) + col * big
        now = new
    now = np.where(col[None] <= lengths[:, None], now, np.iinfo(np.int64).max)
    end = (now // big).argmin(1)
    got = now[np.arange(lanes), end]
    return got // big, big - 1 - got % big, end


class Index:
    """Passages, their pair filter and their keys for every walk."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, at = symbols(texts)
        rows = [(i, h[a:b]) for i, a, b in zip(ids, at[:-1], at[1:], strict=True) if b > a]
        rows.sort(key=lambda r: len(r[1]) < LEAST)
        self.ids = [i for i, _ in rows]
        self.items = [w for _, w in rows]
        sizes = [len(w) for w in self.items if len(w) >= LEAST]  # of the first items; the short ones follow
        self.exact = np.array([not edits_allowed(len(w)) for w in self.items], bool)
        self.pieces = self._pieces(len(sizes))
        self.longest = max((n + edits_allowed(n) for n in sizes), default=0)
        self.hits = min((-(-(n - 1 - 2 * edits_allowed(n)) // -(-(n + edits_allowed(n)) // _SPAN)) for n in sizes), default=1)
        self.pairs = np.unique(np.concatenate([_pairs(w) for w in self.items[: len(sizes)]] or [np.zeros(0, np.uint64)]))
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.pairs >> _U(42)).astype(np.int64)] = True
        self.classes = {c: [i for i, n in enumerate(sizes) if size_class(n) == c] for c in {size_class(n) for n in sizes}}
        #: For each class, the least number of known pairs and the words that hold them.
        self.reach = {c: (min(sizes[i] - 1 - 2 * edits_allowed(sizes[i]) for i in m), max(sizes[i] + edits_allowed(sizes[i]) for i in m)) for c, m in self.classes.items()}
        self.steps = {}
        for c, members in self.classes.items():
            shortest = min(sizes[i] for i in members)
            for w in range(WALKS):
                draw = np.random.default_rng([c, w, 7])
                self.steps[c, w] = np.sort(draw.choice(max(SAMPLED, int(1.6 * shortest)), SAMPLED, replace=False))
        joined = np.concatenate(self.items[: len(sizes)]) if sizes else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.keys = {}
        for w in range(WALKS):
            got = self.walk(joined, np.asarray(starts), np.asarray(ends), w)
            for c, members in self.classes.items():
                k = got[c][members]
                order = np.argsort(k, kind="stable")
                self.keys[c, w] = (k[order], np.asarray(members)[order])

    def _pieces(self, first: int) -> dict[int, tuple[np.ndarray, ...]]:
        """For each length of a piece of the items from first on: hashes in order, with their items and places in these."""
        held: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(first, len(self.items)):
            w = self.items[i]
            parts = edits_allowed(len(w)) + 1
            cuts = [len(w) * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                held.setdefault(b - a, []).append((int(_runs(w[a:b], b - a)[0]), i, a))
        out = {}
        for n, rows in held.items():
            rows.sort()
            keys = np.array([k for k, _, _ in rows], np.uint64)
            quick = np.zeros(1 << 22, bool)
            quick[(keys >> _U(42)).astype(np.int64)] = True
            out[n] = keys, np.array([i for _, i, _ in rows]), np.array([a for *_, a in rows]), quick
        return out

    def short_candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, short item and starting word where a piece of the item stands."""
        found = []
        for n, (keys, items, places, quick) in self.pieces.items():
            r = _runs(h, n)
            lanes = np.flatnonzero(quick[(r >> _U(42)).astype(np.int64)])
            who = np.searchsorted(at, lanes, "right") - 1
            inside = lanes + n <= at[who + 1]
            lanes, who = lanes[inside], who[inside]
            a, b = np.searchsorted(keys, r[lanes], "left"), np.searchsorted(keys, r[lanes], "right")
            count = b - a
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            lanes, who, item = np.repeat(lanes, count), np.repeat(who, count), items[k]
            start = np.maximum(lanes - places[k], at[who])
            # without edits the first place in a text is the answer
            order = np.lexsort((start, who, item))
            again = np.zeros(len(order), bool)
            again[1:] = (item[order][1:] == item[order][:-1]) & (who[order][1:] == who[order][:-1])
            keep = order[~(again & self.exact[item][order])]
            found.append((who[keep], item[keep], start[keep]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def walk(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int) -> dict[int, np.ndarray]:
        """The key of each class for the walk w from each start."""
        wanted: dict[int, list[int]] = {}
        for c in self.classes:
            for j in self.steps[c, w]:
                wanted.setdefault(int(j), []).append(c)
        keys = {c: np.zeros(len(starts), np.uint64) for c in self.classes}
        at = starts.astype(np.int64).copy()
        last = max(0, len(h) - 1)
        for j in range(max(wanted, default=-1) + 1):
            s = np.where(at < ends, h[np.minimum(at, last)], _PAD)
            for c in wanted.get(j, ()):
                keys[c] = chars.mix(keys[c] * chars.M1 + s)
            odd = chars.mix(np.array([w * 100_003 + j + 1], np.uint64) * chars.GOLD) | _U(1)
            at += (s * odd[0] >> _U(63)).astype(np.int64)
        return keys

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, item and starting word of windows that collide with a passage."""
        none = (np.zeros(0, np.int64),) * 3
        if len(h) < 2 or not self.classes:
            return none
        p = _pairs(h)
        hit = np.flatnonzero(self.quick[(p >> _U(42)).astype(np.int64)])
        if not len(hit):
            return none
        place = np.minimum(np.searchsorted(self.pairs, p[hit]), len(self.pairs) - 1)
        hit = hit[self.pairs[place] == p[hit]]
        near = hit[self.hits - 1 :] - hit[: len(hit) - self.hits + 1] < _SPAN
        dense = hit[: len(near)][near]
        if not len(dense):
            return none
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.maximum(dense - self.longest, 0), 1)
        np.add.at(edge, np.minimum(dense + _SPAN, len(h)), -1)
        starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        who = np.searchsorted(at, starts, "right") - 1
        ends = at[who + 1]
        # a passage that starts here has its pairs within its own reach
        before = np.zeros(len(h) + 1, np.int64)
        before[hit + 1] = 1
        before = np.cumsum(before)
        live = np.zeros(len(starts), bool)
        for low, high in self.reach.values():
            to = np.minimum(starts + high, ends)
            live |= before[to] - before[starts] >= low
        starts, who, ends = starts[live], who[live], ends[live]
        found = []
        for w in range(WALKS):
            got = self.walk(h, starts, ends, w)
            for c in self.classes:
                known, items = self.keys[c, w]
                a, b = np.searchsorted(known, got[c], "left"), np.searchsorted(known, got[c], "right")
                n = b - a
                lanes = np.flatnonzero(n)
                if len(lanes):
                    lane = np.repeat(lanes, n[lanes])
                    k = np.arange(len(lane)) - np.repeat(np.cumsum(n[lanes]) - n[lanes], n[lanes]) + np.repeat(a[lanes], n[lanes])
                    found.append(np.unique(lane * len(self.items) + items[k]))
        if not found:
            return none
        both = np.unique(np.concatenate(found))
        lane, item = both // len(self.items), both % len(self.items)
        return who[lane], item, starts[lane]

    def matches(self, texts: list) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, starting word, words, edits) of each passage found in each text.

        One very long text is searched in runs, each with as many words before it as a passage can span.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        reach = max((len(w) + edits_allowed(len(w)) for w in self.items), default=0)
        before, words = "", 0
        for part in chars.rounds(texts, _CHARS):
            own = [before + part[0]] if before else part
            ahead = len(symbols([before])[0]) if before else 0
            for t, i, s, m, k in self._matches(own):
                row = (k, s + words - ahead, m)
                best[t, i] = min(best.get((t, i), row), row)
            if len(texts) == 1 and part[0]:
                words += len(symbols(part)[0])
                before = chars.tail(own[0], reach, chars.symbol_spans) if reach else ""
        return sorted((t, self.ids[i], s, m, k) for (t, i), (k, s, m) in best.items())

    def _matches(self, texts: list) -> list[tuple[int, int, int, int, int]]:
        h, at = symbols(texts)
        who, item, start = map(np.concatenate, zip(self.candidates(h, at), self.short_candidates(h, at), strict=True))
        out = []
        order = np.lexsort((start, who, item))
        who, item, start = who[order], item[order], start[order]
        for i in np.unique(item):
            own = item == i
            words = self.items[i]
            n, e = len(words), edits_allowed(len(words))
            w, s = who[own], start[own]
            # one verification covers all starts within a passage's length
            cell = (s - at[w]) // n
            keep = np.flatnonzero(np.diff(w * (1 << 40) + cell, prepend=-1))
            w, cell = w[keep], cell[keep]
            a = np.maximum(at[w], at[w] + cell * n - 2 * e)
            b = np.minimum(at[w + 1], at[w] + (cell + 2) * n + 3 * e)
            best: dict[int, tuple] = {}
            for x in range(0, len(w), 256):
                aa, bb, ww = a[x : x + 256], b[x : x + 256], w[x : x + 256]
                grid = h[np.minimum(aa[:, None] + np.arange(int((bb - aa).max()))[None], len(h) - 1)]
                edits, first, last = best_matches(words, grid, bb - aa)
                for t, k, f, z, base in zip(ww.tolist(), edits.tolist(), first.tolist(), last.tolist(), (aa - at[ww]).tolist(), strict=True):
                    if k <= e:
                        row = (k, base + f, z - f)
                        best[t] = min(best.get(t, row), row)
            out += [(t, i, s, m, k) for t, (k, s, m) in best.items()]
        return out


@lru_cache(maxsize=1)
def _index(place: str) -> Index:
    """The passages of a block, read where they are needed."""
    store, base = pafs.FileSystem.from_uri(place)
    rows = pq.read_table(base, filesystem=store, columns=["item", "text"], partitioning=None).sort_by([("item", "ascending"), ("text", "ascending")])
    return Index(rows.column("item").to_pylist(), rows.column("text").to_pylist())


def _stored_blocks(spark, benchmark: DataFrame, item: str, block_words: int) -> list[str]:
    """Places in the shared folder of the passages, in blocks of about block_words words at most."""
    items = benchmark.where(F.col(item).isNotNull() & F.col("text").isNotNull()).select(F.col(item).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    unspaced = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in chars.UNSPACED)
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", f"[^{unspaced}]", "")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    folder = fresh_path(spark, "passages")
    kept = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    kept.repartition("block").write.partitionBy("block").parquet(folder)
    have = spark.read.schema("block int").parquet(folder).distinct().collect() if total else []  # a number a block
    return [f"{folder}/block={r['block']}" for r in sorted(have)]


def _searched(rows: DataFrame, places: list[str], ddl: str) -> DataFrame:
    """Of each match the columns of rows before the text, its last, and item_id, start_word, n_words, edits. A block of passages is a pass over the rows."""
    kind, out = arrow.schema(None, f"{ddl}, item_id long, start_word long, n_words long, edits long")
    result = None
    for place in places:

        @arrow.settled
        def run(batches: Iterator[pa.RecordBatch], place=place) -> Iterator[pa.RecordBatch]:
            own = _index(place)
            for b in batches:
                texts = b.column(b.num_columns - 1).to_pylist()
                for i, j in chars.blocks(texts, _CHARS):
                    got = own.matches(texts[i:j])
                    at = pa.array([i + t for t, *_ in got], pa.int64())
                    yield arrow.batch(out, *[c.take(at) for c in b.columns[:-1]], *([r[c] for r in got] for c in range(1, 5)))

        found = rows.mapInArrow(run, kind)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else rows.sparkSession.createDataFrame([], kind)


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits: each passage of the benchmark that a document holds."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string"))
    result = _searched(rows, _stored_blocks(docs.sparkSession, benchmark, item, block_words), "doc_id long")
    first = F.min(F.struct("edits", "start_word", "n_words")).alias("m")
    return result.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "m.start_word", "m.n_words", "m.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark.

    One block of passages is a filter where the rows are read. With more, each
    is a pass that gives the digests of the texts that go; only rows whose
    digest may be among them are joined to those.
    """
    places = _stored_blocks(docs.sparkSession, benchmark, item, block_words)
    if len(places) <= 1:

        def keep(texts: list) -> list[bool]:
            own, out = _index(places[0]), []
            for i, j in chars.blocks(texts, _CHARS):
                hit = {t for t, *_ in own.matches(texts[i:j])}
                out += [t not in hit for t in range(j - i)]
            return out

        return arrow.filtered(docs, text, keep) if places else docs
    whole = F.col(text).cast("string")
    h, g = F.xxhash64(whole), F.xxhash64(F.lit(1), whole)
    rows = docs.where(F.col(text).isNotNull()).select(h.alias("h"), g.alias("g"), whole.alias("text"))
    gone = written(_searched(rows, places, "h long, g long").select("h", "g").distinct(), "contaminated")
    maybe, rest = sieve.parted(docs, F.when(F.col(text).isNotNull(), h), gone.select("h"))
    left = maybe.join(gone, (h == gone["h"]) & (g == gone["g"]), "left_anti")
    return rest.unionByName(left.select(docs.columns))
