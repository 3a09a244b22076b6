"""Operator 6: token counts without token ids.

A text's count is the sum, over its pre-tokens, of the pieces of each. So the
pieces of each distinct pre-token of the corpus are counted once, by the
tokenizers library, and joined to the pre-tokens of each document. The most
frequent pre-tokens (top, a bounded table) are broadcast and summed where the
text is; the rest are joined by Spark. The special string of the vocabulary
inside a text is one token and splits the text, as is the library's default.

Another vocabulary file of the same kind may be given; one that splits texts
otherwise is refused.

Defined cases: a null or empty text has 0 tokens; a very long text is worked
through in runs that part where no pre-token spans; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars
from scribeflow.runtime import written

#: Pre-tokens that are broadcast: at 16 bytes each about 3 MB, whatever the input.
TOP = 200_000
_CHARS = 1_000_000


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> tuple[str, ...]:
    """The special strings of a vocabulary file; ValueError if its texts aren't split as this module splits them."""
    import json

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    split = own.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not own.get("normalizer")
    if not plain or any(x[k] for x in own["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: only byte-level vocabularies with the public pattern, no prefix blank and no normaliser are counted here")
    return tuple(x["content"] for x in own["added_tokens"])


def _laid_out(texts: list, special: tuple[str, ...]):
    """The texts joined, with special strings taken out: joined text, part starts, owner of each part, specials by text."""
    parts, owner, found = [], [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        if not x:
            continue
        pieces = [x]
        for s in special:
            if s in x:
                cut = [p.split(s) for p in pieces]
                found[i] += sum(len(c) - 1 for c in cut)
                pieces = [p for c in cut for p in c]
        for p in pieces:
            if p:
                parts.append(p)
                owner.append(i)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return "".join(parts), np.cumsum(sizes) - sizes, np.asarray(owner, np.int64), found


def _tokens(texts: list, special: tuple[str, ...]):
    """Joined text, start, length, hash and owning text of each pre-token; specials by text."""
    text, cuts, owner, found = _laid_out(texts, special)
    c, starts = chars.pretokens(text, cuts)
    lengths = np.diff(np.append(starts, len(c)))
    who = owner[np.searchsorted(cuts, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    return text, starts, lengths, chars.span_hashes(c, starts, lengths), who, found


def vocabulary(docs: DataFrame, special: tuple[str, ...], text: str = "text") -> DataFrame:
    """token, key (its hash) and n: the distinct pre-tokens of the corpus and how often they occur."""
    kind, out = arrow.schema(None, "token string, key long, n long")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in (r for i, j in chars.blocks(texts, _CHARS) for r in chars.rounds(texts[i:j], _CHARS)):
                joined, starts, lengths, keys, _, _ = _tokens(part, special)
                got, first, n = np.unique(keys, return_index=True, return_counts=True)
                s = starts[first].tolist()
                e = (starts[first] + lengths[first]).tolist()
                yield arrow.batch(out, [joined[a:z] for a, z in zip(s, e, strict=True)], got.view(np.int64), n)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, kind).groupBy("token", "key").agg(F.sum("n").alias("n"))


def pieces(vocab: DataFrame, path: str) -> DataFrame:
    """vocab with the number of pieces of each pre-token."""
    kind, out = arrow.schema(None, "token string, key long, n long, pieces int")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = [len(e) for e in tk.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield arrow.batch(out, part.column(0), part.column(1), part.column(2), got)

    return vocab.mapInArrow(run, kind)


def _frequent(counted: DataFrame, top: int) -> DataFrame:
    """key, pieces of the pre-tokens that occur most often: all above a frequency, and at most top of them.

    The frequency comes from a histogram with eight steps to a doubling, a few hundred rows at any size, so
    that no task has to sort what all others found.
    """
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for s, n in sorted(map(tuple, counted.groupBy(step.alias("s")).count().collect()), reverse=True):
        total += n
        if total > top:
            break
        least = s
    return counted.where(F.lit(False) if least is None else step >= least).select("key", "pieces")


def count_tokens(docs: DataFrame, path: str | None = None, over: int = 512, text: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    special = specials(path)
    counted = written(pieces(vocabulary(docs, special, text), path), "pieces")
    frequent = _frequent(counted, top).toArrow()
    keys, sizes = frequent.column(0).to_numpy(), frequent.column(1).to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], sizes[order].astype(np.int64)))
    kind, out = arrow.schema(None, "doc_id long, row long, n_bytes long, base long, rare array<struct<token: string, f: int>>")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = shared.value
        for b in batches:
            ids, rows, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for i, j in chars.blocks(texts, _CHARS):
                base, rare = np.zeros(j - i, np.int64), [{} for _ in range(i, j)]
                for part in chars.rounds(texts[i:j], _CHARS):
                    joined, starts, lengths, h, who, found = _tokens(part, special)
                    h = h.view(np.int64)
                    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                    base += found + np.bincount(who[hit], size[at[hit]] if len(known) else None, len(part)).astype(np.int64)
                    miss = np.flatnonzero(~hit)
                    for w, s, e in zip(who[miss].tolist(), starts[miss].tolist(), (starts[miss] + lengths[miss]).tolist(), strict=True):
                        t = joined[s:e]
                        rare[w][t] = rare[w].get(t, 0) + 1
                flat = [(t, f) for r in rare for t, f in r.items()]
                ends = np.cumsum([0] + [len(r) for r in rare])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([f for _, f in flat], pa.int32())], ["token", "f"]))
                n_bytes = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts[i:j]]
                yield arrow.batch(out, ids[i:j], rows[i:j], n_bytes, base, lists.cast(out.field("rare").type))

    # a row's number keeps repeated rows apart; it is used inside this one plan only
    per = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string")).mapInArrow(run, kind)
    per = written(per, "pretokens")
    rest = (
        per.select("row", F.explode("rare").alias("r"))
        .select("row", "r.token", "r.f")
        .join(counted.select("token", "pieces"), "token")
        .groupBy("row")
        .agg(F.sum(F.col("f") * F.col("pieces")).alias("more"))
    )
    n = F.col("base") + F.coalesce(F.col("more"), F.lit(0))
    return per.select("doc_id", "row", "n_bytes", "base").join(rest, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > over).alias("over_limit"))
