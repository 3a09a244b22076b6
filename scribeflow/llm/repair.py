"""Operator 11: token ids as files compressed by a Re-Pair grammar, with random access.

Texts are ordered by id through range partitions, encoded by the tokenizers
library, and each partition's ids become one file of shards, each with a
grammar of its own: rounds replace frequent pairs of neighbours by
nonterminals, in all places at once; where pairs overlap the more frequent one
has precedence, so what a round replaces is what pair after pair would. A pair
is frequent if it is replaced LEAST times, as a rule takes the room of two
symbols, and rounds end when one shortens the shard by less than a GAIN-th.
Rules are stored with the number of ids that they expand to, so a range of ids
is decoded by searching the symbols' sums and opening only the rules that
overlap it.

A file: shards, then a directory (their places, and each document's id, start
and length), then the directory's place. Shards and directory carry checksums.
Symbols take as many bits as the grammar needs.

Each distinct pre-token of a task is encoded once (its ids are kept in a table
of bounded size), which gives the library's ids, since its merges never span
pre-tokens; texts that hold a special string go to the library whole.

Defined cases: a null or empty text has the end id alone; rows without an id
come first; rows of one id are ordered by a hash of their texts; repeated rows
are documents of their own; a very long text is worked through in runs and may
span shards, while other documents share one; an empty table gives no files and
an empty result; other columns are ignored. A damaged file is refused with
ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars, tokencount
from scribeflow.runtime import cut_lineage, fresh_path, tasks_for

MAGIC = b"REPAIR01"
#: Ids of a shard, uses of a pair that is worth a rule, and the share by which a round that isn't the last shortens a shard.
SHARD, LEAST, GAIN = 1 << 18, 4, 128
#: Bytes of text in a file, about; ids that a reader decodes at once; pre-tokens whose ids a worker keeps, at most.
FILE_BYTES, WINDOW, KEPT = 64 << 20, 1 << 16, 1 << 21
END = 0
_CHARS = 1_000_000
_HEAD, _FOOT, _TAIL = struct.Struct("<IIIQ"), struct.Struct("<IQ"), struct.Struct("<QI8s")
_NONE = np.int32((1 << 31) - 1)
_SLOTS = 18


class Encoder:
    """Ids of texts; each distinct pre-token goes to the library once, as long as it is kept.

    What is kept is a table by hash: a pre-token has one slot, and leaves it to the next one that needs it.
    """

    def __init__(self, path: str, slots: int = KEPT):
        self.tk, self.special = tokencount.tokenizer(path), tokencount.specials(path)
        self.mask = np.uint64(slots - 1)
        self.keys, self.first, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.ids, self.used = np.zeros(1024, np.uint32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts in turn, and how many each has."""
        got = [e.ids for i in range(0, len(texts), 2000) for e in self.tk.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens that hold no special string: asked many at a time, with one between them as a mark."""
        if not self.special:
            return self._library(words)
        mark, ids, sizes = self.tk.token_to_id(self.special[0]), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 500):
            own = words[i : i + 500]
            marked = [self.special[0]] * (2 * len(own))
            marked[::2] = own
            got = np.array(self.tk.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            at = got == mark
            ids.append(got[~at])
            sizes.append(np.diff(np.flatnonzero(at), prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _gathered(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _store(self, ids: np.ndarray) -> int:
        """Where ids are put. What no slot needs any more goes once it is most of what is held."""
        if self.used + len(ids) > len(self.ids):
            live = np.flatnonzero(self.size)
            held = self._gathered(self.first[live], self.size[live])
            self.first[live] = np.cumsum(self.size[live]) - self.size[live]
            self.ids, self.used = np.zeros(2 * (len(held) + len(ids)), np.uint32), len(held)
            self.ids[: len(held)] = held
        at, self.used = self.used, self.used + len(ids)
        self.ids[at : self.used] = ids
        return at

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, starts, lengths, h, who, _ = tokencount._tokens(texts, ())
        got, place, back = np.unique(h, return_index=True, return_inverse=True)
        slot = got & self.mask
        missing = np.flatnonzero((self.keys[slot] != got) | (self.size[slot] == 0))
        at = place[missing]
        new, sizes = self._words([joined[s:e] for s, e in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)])
        begin = self._store(new)
        first, size = self.first[slot], self.size[slot]
        first[missing], size[missing] = begin + np.cumsum(sizes) - sizes, sizes
        out = self._gathered(first[back], size[back]), np.bincount(who, size[back], len(texts)).astype(np.int64)
        self.keys[slot], self.first[slot], self.size[slot] = got, first, size
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each text has."""
        odd = [i for i, x in enumerate(texts) if any(s in x for s in self.special)]
        if not odd:
            return self._plain(texts)
        flat, size, at = [], [], 0
        for i in [*odd, len(texts)]:
            ids, n = self._plain(texts[at:i])
            flat.append(ids)
            size.append(n)
            if i < len(texts):
                ids, n = self._library([texts[i]])
                flat.append(ids)
                size.append(n)
            at = i + 1
        return np.concatenate(flat), np.concatenate(size)


@cache
def encoder(path: str) -> Encoder:
    """This worker's: tasks that follow one another in it share what it has learnt."""
    return Encoder(path)


def documents_of(enc: Encoder, texts: list[str | None], limit: int = _CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of texts, each followed by END, in parts: the part's ids and the length of each document that ends in it."""
    for i, j in chars.blocks(texts, limit):
        block = [x or "" for x in texts[i:j]]
        if len(block) == 1 and len(block[0]) > limit:
            before = 0
            for part in chars.runs(block[0], limit):
                ids, _ = enc.encode([part])
                before += len(ids)
                yield ids, np.zeros(0, np.int64)
            yield np.array([END], np.uint32), np.array([before + 1])
        else:
            ids, size = enc.encode(block)
            yield np.insert(ids, np.cumsum(size), END), size + 1


def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
    return (((keys.view(np.uint64) ^ np.uint64(salt)) * chars.GOLD) >> np.uint64(64 - _SLOTS)).view(np.int64)


def grammar(ids: np.ndarray, least: int = LEAST, gain: int = GAIN) -> tuple[int, np.ndarray, np.ndarray]:
    """The first nonterminal's number, the rules (two symbols each, older ones first) and the symbols that ids become."""
    seq = ids.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 1
    rules, symbols = [np.zeros((0, 2), np.int64)], base
    slots = np.empty(1 << _SLOTS, np.int32)
    names: dict[int, int] = {}
    while len(seq) > 1:
        keys = (seq[:-1] << 32) | seq[1:]
        ordered = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = count >= least
        if not often.any():
            break
        pairs, count = ordered[first[often]], count[often]
        pairs = pairs[np.argsort(-count, kind="stable")]  # the most frequent first
        # a hash table finds each place's pair; of pairs that share a slot the more frequent goes first, the other in a later round
        slots[:] = len(pairs)
        slots[_slot(pairs[::-1], symbols)] = np.arange(len(pairs))[::-1]
        rank = slots[_slot(keys, symbols)]
        here = np.full(len(keys) + 2, _NONE)
        some = np.flatnonzero(rank < len(pairs))
        some = some[pairs[rank[some]] == keys[some]]
        here[some + 1] = rank[some]
        wins = (here[1:-1] < _NONE) & (here[1:-1] <= here[2:]) & (here[1:-1] <= here[:-2])
        again = wins & (here[1:-1] == here[:-2])
        place = np.flatnonzero(again)
        if len(place):  # runs of one symbol: every other place of its pair
            starts = np.flatnonzero(np.diff(place, prepend=-2) > 1)
            before = place - np.repeat(place[starts], np.diff(np.append(starts, len(place))))
            wins[place[before % 2 == 0]] = False
        won = np.flatnonzero(wins)
        pair = here[won + 1]
        kept = np.bincount(pair, minlength=len(pairs)) >= least
        if not kept.any():
            break
        won, pair = won[kept[pair]], pair[kept[pair]]
        # a pair that lost places to others before has its rule already
        number = np.array([names.get(p, -1) for p in pairs[kept].tolist()])
        fresh = pairs[kept][number < 0]
        number[number < 0] = symbols + np.arange(len(fresh))
        names.update(zip(fresh.tolist(), range(symbols, symbols + len(fresh)), strict=True))
        rules.append(np.stack([fresh >> 32, fresh & 0xFFFFFFFF], 1))
        seq[won] = number[np.cumsum(kept)[pair] - 1]
        symbols += len(fresh)
        stays = np.ones(len(seq), bool)
        stays[won + 1] = False
        before, seq = len(seq), seq[stays]
        if (before - len(seq)) * gain < before:
            break
    return base, np.concatenate(rules), seq


def expansions(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for."""
    size = np.ones(len(rules), np.int64)
    done = np.zeros(len(rules), bool)
    while not done.all():  # a pass for each level of nesting
        inner = rules - base
        ready = ~done & ((inner < 0) | done[np.maximum(inner, 0)]).all(1)
        if not ready.any():
            raise ValueError("rules that hold one another")
        size[ready] = np.where(inner[ready] < 0, 1, size[np.maximum(inner[ready], 0)]).sum(1)
        done |= ready
    return size


def _packed(values: np.ndarray, width: int) -> bytes:
    high = [np.packbits((values >> b) & 1).tobytes() for b in range(16, width)]
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(high)


def _unpacked(data: memoryview, n: int, width: int) -> np.ndarray:
    values = np.frombuffer(data, "<u2", n).astype(np.int64)
    bits = -(-n // 8)
    for k, b in enumerate(range(16, width)):
        values |= np.unpackbits(np.frombuffer(data, np.uint8, bits, 2 * n + k * bits), count=n).astype(np.int64) << b
    return values


def packed_shard(ids: np.ndarray) -> bytes:
    """A shard's bytes: header, rules, the ids they stand for, symbols, checksum."""
    base, rules, seq = grammar(ids)
    width = max(16, int(base + len(rules)).bit_length())
    data = _HEAD.pack(base, len(rules), len(seq), len(ids)) + rules.astype("<u4").tobytes() + expansions(base, rules).astype("<u4").tobytes() + _packed(seq, width)
    return data + struct.pack("<I", zlib.crc32(data))


class Shard:
    """A shard of at most 2^32 ids, any range of which can be decoded by itself."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a shard is cut off or damaged")
        self.base, m, n, self.n_ids = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.rules = np.frombuffer(data, "<u4", 2 * m, at).reshape(m, 2).astype(np.int64)
        self.size = np.frombuffer(data, "<u4", m, at + 8 * m).astype(np.int64)
        self.symbols = _unpacked(memoryview(data)[at + 12 * m :], n, max(16, int(self.base + m).bit_length()))
        self.ends = np.cumsum(self._sizes(self.symbols))
        if self.n_ids != (self.ends[-1] if n else 0):
            raise ValueError("a shard's rules don't give its number of ids")

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.base, 1, self.size[np.maximum(symbols - self.base, 0)])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive); only rules that overlap the range are opened."""
        n = end - start
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, end, "left") + 1
        symbol, size = self.symbols[i:j], self._sizes(self.symbols[i:j])
        place = self.ends[i:j] - size - start
        out = np.zeros(max(n, 0), "<u4")
        while len(symbol):
            here = (place < n) & (place + size > 0)
            symbol, place = symbol[here], place[here]
            plain = symbol < self.base
            out[place[plain]] = symbol[plain]
            inner, place = self.rules[symbol[~plain] - self.base], place[~plain]
            left = self._sizes(inner[:, 0])
            symbol, place = np.concatenate([inner[:, 0], inner[:, 1]]), np.concatenate([place, place + left])
            size = np.concatenate([left, self._sizes(inner[:, 1])])
        return out


class Writer:
    """One file of shards; documents are added in order."""

    def __init__(self, sink, shard: int = SHARD):
        self.sink, self.shard = sink, shard
        self.held: list[np.ndarray] = []
        self.waiting = self.total = self.place = 0
        self.shards: list[tuple[int, int]] = []  # place in the file, first id
        self.names: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.shard:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.shard * self.shard
            for at in range(0, whole, self.shard):
                self._shard(flat[at : at + self.shard])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _shard(self, ids: np.ndarray) -> None:
        data = packed_shard(ids)
        self.shards.append((self.place, self.total))
        self.sink.write(data)
        self.place += len(data)
        self.total += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._shard(np.concatenate(self.held))
        names = np.array([0 if x is None else x for x in self.names], "<i8")
        absent = np.packbits(np.array([x is None for x in self.names], bool))
        directory = _FOOT.pack(len(self.shards), len(names)) + np.array(self.shards, "<u8").tobytes() + np.array([self.place, self.total], "<u8").tobytes()
        directory += names.tobytes() + absent.tobytes() + np.cumsum([0, *self.sizes], dtype="<u8").tobytes()
        self.sink.write(directory + _TAIL.pack(self.place, zlib.crc32(directory), MAGIC))


class Archive:
    """An open file of shards: its documents, and any range of its ids. One shard is held at a time."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        if end < _TAIL.size:
            raise ValueError("not a file of shards")
        source.seek(end - _TAIL.size)
        at, check, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC or at > end - _TAIL.size:
            raise ValueError("not a file of shards")
        source.seek(at)
        data = source.read(end - _TAIL.size - at)
        if zlib.crc32(data) != check:
            raise ValueError("the directory is damaged")
        shards, n = _FOOT.unpack_from(data)
        self.places, self.firsts = np.frombuffer(data, "<u8", 2 * (shards + 1), _FOOT.size).reshape(-1, 2).astype(np.int64).T
        at = _FOOT.size + 16 * (shards + 1)
        names = np.frombuffer(data, "<i8", n, at)
        absent = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8 * n), count=n)
        self.doc_ids = [None if no else x for x, no in zip(names.tolist(), absent.tolist(), strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 8 * n + -(-n // 8)).astype(np.int64)
        self.total = int(self.firsts[-1])
        self._at, self._shard = -1, None

    def _load(self, k: int) -> Shard:
        if self._at != k:
            self.source.seek(int(self.places[k]))
            self._at, self._shard = k, Shard(self.source.read(int(self.places[k + 1] - self.places[k])))
        return self._shard

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the file."""
        out = [np.zeros(0, "<u4")]
        while start < end:
            k = int(np.searchsorted(self.firsts, start, "right")) - 1
            first, last = int(self.firsts[k]), min(end, int(self.firsts[k + 1]))
            out.append(self._load(k).ids(start - first, last - first))
            start = last
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        """Ids of document k, with the end id."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", shard: int = SHARD, parts: int | None = None) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order and returns the manifest: part (in that order), path, docs, ids, bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if parts is None:
        size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100)).first()[0] or 0
        parts = tasks_for(spark, size, FILE_BYTES)
    # the row number parts copies of one row, however many there are
    order = ["doc_id", "hash", "row"]
    rows = own.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind, out = arrow.schema(None, "part int, path string, docs long, ids long, bytes long")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        rest = (b for b in batches if b.num_rows)
        one = next(rest, None)
        if one is None:
            return
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"  # a name of its own: what failed attempts leave is in no manifest
        with store.open_output_stream(name, compression=None) as f:
            w = Writer(f, shard)
            while one is not None:
                w.names += one.column(0).to_pylist()
                for ids, sizes in documents_of(enc, one.column(1).to_pylist()):
                    w.add(ids)
                    w.sizes += sizes.tolist()
                one = next(rest, None)
            w.close()
            size = f.tell()
        yield arrow.batch(out, [TaskContext.get().partitionId()], [name], [len(w.names)], [w.total], [size])

    return cut_lineage(rows.select("doc_id", "text").mapInArrow(run, kind))


def read(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of the manifest; with its ids if asked for."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("part", "path", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    kind, out = arrow.schema(None, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, docs, total, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(path) as f:
                    yield from documents(Archive(f), path, docs, total, base)

    def documents(a: Archive, path: str, docs: int, total: int, base: int) -> Iterator[pa.RecordBatch]:
        if (docs, total) != (len(a.doc_ids), a.total):
            raise ValueError(f"{path} doesn't hold what its manifest says")
        k, crc, parts, rows = 0, 0, [], []
        for at in range(0, total, WINDOW):
            got = a.ids(at, min(at + WINDOW, total))
            here = at
            while k < docs:
                end = int(a.starts[k + 1])
                piece = got[here - at : end - at]
                crc = zlib.crc32(piece, crc)
                if ids:
                    parts.append(piece)
                here = min(end, at + len(got))
                if end > at + len(got):
                    break
                start = int(a.starts[k])
                rows.append((a.doc_ids[k], base + start, end - start, crc, *([np.concatenate(parts).astype(np.int32)] if ids else [])))
                k, crc, parts = k + 1, 0, []
            if rows:
                yield arrow.batch(out, *map(list, zip(*rows, strict=True)))
                rows = []

    count = max(1, manifest.count())
    return files.repartitionByRange(count, "part").select("path", "docs", "ids", "base").mapInArrow(run, kind)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of docs in files in the shared folder, read back: a row for each document."""
    folder = fresh_path(docs.sparkSession, "ids")
    return read(write(docs, folder, path), folder)
