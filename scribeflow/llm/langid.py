"""Operator 4: language identification by cross-parsing entropy.

For each language, a suffix automaton holds every substring of a bounded
labelled sample. A text is parsed against each automaton into phrases, each
the longest match from where the last one ended (the cross-parsing of Ziv and
Merhav); the language that needs the fewest phrases for its symbols wins.

Text is lower-cased; letters count, and a run of anything else is one blank.
A text is parsed whole, as one sequence. To advance much text together as
array operations, pieces of PIECE symbols are first parsed as if each began a
phrase; then each is entered anew with the state that the piece before it
ends in, until both parses stand in one state (mostly after a phrase or two).
Where they don't meet within a piece, a plain walk goes on from there. The
phrases are those of a parse from the first symbol to the last.

The labelled sample has at most DOCS documents a language (those with the
smallest hash of their id) and SYMBOLS symbols of them; only these reference
texts are broadcast, and each worker builds the automata once. Every labelled
language takes part, with every letter of its reference: transitions by a
language's most frequent letters are a table, the others a sorted list. The
sample is chosen on ids alone; only the chosen texts are gathered.

Defined cases: a null text, or one without a letter, gets `und` and score 0;
ties go to the language that sorts first; without labelled rows every text
gets `und`; null languages, texts and ids are no labels; of labelled rows that
repeat an id and language one text counts; very long texts are parsed in runs
of bounded memory; repeated rows are predicted each; other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars

DOCS = 60
SYMBOLS = 30_000
#: Bytes of the transition tables of all languages; transitions that they don't hold are looked up in sorted lists.
TABLES = 128_000_000
PIECE = 512
_CHARS = 1_000_000


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters of text; each run of anything else is one blank; blanks at the ends go."""
    c = chars.codes(text.lower())
    c = np.where(chars.classes()[c] == chars.LETTER, c, np.uint32(32))
    keep = c != 32
    keep[1:] |= keep[:-1]
    c = c[keep]
    return c[:-1] if len(c) and c[-1] == 32 else c


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of symbols (0 parts texts).

    State 0 is the start; no transition leads to it.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(transitions: dict[int, int], size: int) -> int:
        step.append(transitions)
        link.append(0)
        length.append(size)
        return len(step) - 1

    def split(p: int, s: int, q: int) -> int:
        clone = state(dict(step[q]), length[p] + 1)
        link[clone] = link[q]
        while p >= 0 and step[p].get(s) == q:
            step[p][s] = clone
            p = link[p]
        link[q] = clone
        return clone

    last = 0
    for s in symbols:
        if not s:
            last = 0
            continue
        q = step[last].get(s)
        if q:  # the start of a later text may be there already
            last = q if length[q] == length[last] + 1 else split(last, s, q)
            continue
        new = state({}, length[last] + 1)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            link[new] = q if length[q] == length[p] + 1 else split(p, s, q)
        last = new
    return step


class Language:
    """A language's automaton over all letters of its reference."""

    def __init__(self, texts: list[np.ndarray], size: int, columns: int):
        """texts: symbols below size; columns: the most frequent symbols whose transitions are a table."""
        joined = np.concatenate([x for t in texts for x in (t, [0])] or [np.zeros(0)])[: SYMBOLS + 1].astype(np.int64)
        n = np.bincount(joined, minlength=size)
        n[0] = 0
        known = np.flatnonzero(n)
        self.own = np.zeros(size, np.int64)  # a symbol's number in this language, by frequency; 0: in no text
        self.own[known[np.lexsort((known, -n[known]))]] = 1 + np.arange(len(known))
        step = automaton(self.own[joined].tolist())
        self.all = len(known) + 1
        self.width = min(self.all, columns + 1)
        out = [len(t) for t in step]
        at = np.repeat(np.arange(len(step)), out)
        s = np.fromiter((k for t in step for k in t), np.int64, len(at))
        to = np.fromiter((v for t in step for v in t.values()), np.int32, len(at))
        self.start = np.zeros(self.all, np.int64)
        self.start[s[: out[0]]] = to[: out[0]]
        often = s < self.width
        self.table = np.zeros(len(step) * self.width, np.int32)
        self.table[at[often] * self.width + s[often]] = to[often]
        key = (at * self.all + s)[~often]
        order = np.argsort(key)
        self.keys, self.targets = key[order], to[~often][order]

    def after(self, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The state after the symbol s from each state at; 0 for none."""
        if self.width == self.all:
            return self.table[at * self.width + s]
        to = self.table[at * self.width + np.where(s < self.width, s, 0)]
        rare = np.flatnonzero(s >= self.width)
        key = at[rare] * self.all + s[rare]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to[rare] = np.where(self.keys[place] == key, self.targets[place], 0)
        return to

    def advance(self, at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the symbols s, and the phrases that they end: that before s, and s itself if it is in no text."""
        to = self.after(at, s)
        end = to == 0
        fresh = self.start[s]
        ended = (end & (at > 0)).view(np.uint8) + (end & (fresh == 0)).view(np.uint8)
        return np.where(end, fresh, to), ended

    def walk(self, at: int, symbols: np.ndarray, states: np.ndarray) -> tuple[list[int], list[int]]:
        """States and ended phrases from the state at on, up to the first place where states has the same."""
        out, ended = [], []
        for s, known in zip(symbols.tolist(), states.tolist(), strict=True):
            to = self.table.item(at * self.width + s) if s < self.width else int(self.after(np.array([at]), np.array([s]))[0])
            count = 0
            if not to:
                to = self.start.item(s)
                count = (at > 0) + (to == 0)
            at = to
            out.append(at)
            ended.append(count)
            if at == known:
                break
        return out, ended

    def parse(self, grid: np.ndarray, lengths: np.ndarray, before: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each piece, and the state at its end.

        grid: the pieces' symbols as columns, 0 after the end, longest first; before: the piece that each continues,
        or -1; entry: the state in which the others start.
        """
        rows, lanes = grid.shape
        own = self.own[grid]
        states, ended = np.zeros((rows, lanes), np.int32), np.zeros((rows, lanes), np.uint8)
        used = np.where(before < 0, entry, 0)
        at = used.astype(np.int64)
        for row, n in enumerate(np.searchsorted(-lengths, -np.arange(1, rows + 1), "right")):
            at[:n], ended[row, :n] = self.advance(at[:n], own[row, :n])
            states[row, :n] = at[:n]
        tip = lengths - 1, np.arange(lanes)
        enters = lambda: np.where(before < 0, used, states[tip][before])
        cur = np.flatnonzero(used != enters())
        used = enters()
        at = used[cur].astype(np.int64)
        for row in range(rows):
            if not len(cur):
                break
            at, ended[row, cur] = self.advance(at, own[row, cur])
            apart = states[row, cur] != at
            states[row, cur] = at
            apart &= lengths[cur] > row + 1
            cur, at = cur[apart], at[apart]
        stale = np.flatnonzero(used != enters())
        if len(stale):  # pieces whose predecessor's end changed once more: from here on one after the other
            after = np.full(lanes, -1)
            after[before[before >= 0]] = np.flatnonzero(before >= 0)
            depth = np.zeros(lanes, np.int64)
            heads, n = np.flatnonzero(before < 0), 0
            while len(heads):
                depth[heads] = n
                heads, n = after[heads], n + 1
                heads = heads[heads >= 0]
            for lane in stale[np.argsort(depth[stale], kind="stable")]:
                while lane >= 0:
                    now = int(states[lengths[before[lane]] - 1, before[lane]])
                    if now == used[lane]:
                        break
                    used[lane] = now
                    got, count = self.walk(now, own[: lengths[lane], lane], states[: lengths[lane], lane])
                    states[: len(got), lane], ended[: len(got), lane] = got, count
                    lane = after[lane]
        return ended.sum(axis=0, dtype=np.int64), states[tip]


class Parser:
    """The automata of all languages."""

    def __init__(self, references: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [lang for lang, _ in references]
        norm = [[normal(t) for t in texts] for _, texts in references]
        letters = np.unique(np.concatenate([c for texts in norm for c in texts] or [np.zeros(0, np.uint32)]))
        letters = letters[letters != 32]
        self.symbol = np.ones(0x110000, np.int32)  # 1: a letter of none; it is in no automaton
        self.symbol[32] = 2
        self.symbol[letters] = 3 + np.arange(len(letters))
        columns = TABLES // (4 * 2 * SYMBOLS * max(1, len(norm)))
        self.tables = [Language([self.symbol[c] for c in texts], 3 + len(letters), columns) for texts in norm]

    def phrases(self, texts: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each text (symbols) by language, parsed on from the states entry, and the states at the ends."""
        out, last = np.zeros((len(self.tables), len(texts)), np.int64), entry.copy()
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return out, last
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(sizes) - sizes)[owner] + inside * PIECE
        length = np.minimum(PIECE, sizes[owner] - inside * PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(inside > 0, place[np.arange(len(owner)) - 1], -1)[order]
        padded = np.concatenate([*texts, np.zeros(PIECE, np.int32)])
        rows = np.arange(int(length.max()))
        grid = np.ascontiguousarray(padded[start[order, None] + rows[None]].T)
        grid[rows[:, None] >= length[order][None]] = 0
        final = np.flatnonzero(inside == pieces[owner] - 1)
        for t, language in enumerate(self.tables):
            ended, states = language.parse(grid, length[order], before, entry[t][owner[order]])
            out[t] = np.bincount(owner[order], ended, len(texts))
            last[t][owner[final]] = states[place[final]]
        return out, last

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language and score of each text. Texts above _CHARS are parsed in runs."""
        total, sizes = np.zeros((len(self.tables), len(texts)), np.int64), np.zeros(len(texts), np.int64)
        entry = np.zeros((len(self.tables), len(texts)), np.int64)
        runs = [chars.runs(x or "", _CHARS) for x in texts]
        live = list(range(len(texts)))
        while live:
            part, more = [], []
            for i in live:
                x = next(runs[i], None)
                if x is not None:
                    c = normal(x)
                    if len(c) and sizes[i]:
                        c = np.concatenate([np.array([32], c.dtype), c])  # runs part at white space
                    part.append(self.symbol[c])
                    more.append(i)
            live = more
            if live:
                own = np.array(live)
                ended, entry[:, own] = self.phrases(part, entry[:, own])
                total[:, own] += ended
                sizes[own] += [len(c) for c in part]
        if not self.tables:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate = total / np.maximum(sizes, 1)
        best = rate.argmin(axis=0)
        odds = np.exp(-12 * (rate - rate.min(axis=0)))
        score = odds.max(axis=0) / odds.sum(axis=0)
        return [self.languages[b] if n else "und" for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0)


@lru_cache(maxsize=2)
def parser(references: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    return Parser(references)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The reference texts of each language: a bounded sample of the labelled documents."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))  # each task keeps DOCS ids a language before the shuffle
    ids = rows.select("id", "lang").distinct().withColumn("place", rank).where(F.col("place") <= DOCS)
    short = rows.withColumn("text", F.substring("text", 1, SYMBOLS))  # of the references alone; predictions read whole texts
    chosen = short.join(F.broadcast(ids), ["id", "lang"])  # DOCS ids a language
    ids = chosen.groupBy("lang", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held: dict[str, list[str]] = {}
    for r in ids.orderBy("lang", "place").toLocalIterator():
        texts = held.setdefault(r["lang"], [])
        if sum(map(len, texts)) < SYMBOLS:
            texts.append(r["text"])
    return tuple((k, tuple(v)) for k, v in sorted(held.items()))


def identify(docs: DataFrame, references: tuple[tuple[str, tuple[str, ...]], ...], text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(references)
    kind, out = arrow.schema(None, "doc_id long, lang_pred string, score double")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chars.blocks(texts, _CHARS):
                yield arrow.batch(out, b.column(0)[i:j], *own.predict(texts[i:j]))

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)
