"""Operator 9: byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file (a parameter, never copied here). A text is
split by the public pattern and each match is merged on its own, without
special tokens. Long texts are cut before white space that follows something
else: no match of the pattern spans such a place, so the ids are those of the
whole text. Decoding joins the raw bytes of the ids, so text that isn't valid
on token borders survives.

Defined cases: a null text counts as empty (no ids); a long text without white
space is one part, and one long match of the pattern is merged as a whole, as
the library does it; an empty table gives an
empty result; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars

#: Characters above which a text is cut at safe places.
LONG = 50_000


@cache
def encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, path: str, pattern: str, limit: int = LONG) -> np.ndarray:
    enc = encoding(path, pattern)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in chars.runs(text or "", limit)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves if asked for."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind, out = arrow.schema(None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            size, id_sums, text_sums, lists = [], [], [], []
            for x in b.column(1):
                got = encode_text(x.as_py(), path, pattern).astype("<u4", copy=False)
                size.append(len(got))
                id_sums.append(hashlib.sha256(got.tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(enc.decode_bytes(got.tolist())).hexdigest())
                if ids:
                    lists.append(got.astype(np.int32))
            yield arrow.batch(out, b.column(0), size, id_sums, text_sums, *[lists] * ids)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the raw bytes that the ids of each row stand for (null ids: no bytes)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind, out = arrow.schema(None, "doc_id long, bytes binary")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            yield arrow.batch(out, b.column(0), [enc.decode_bytes(x.as_py() or []) for x in b.column(1)])

    return encoded.select("doc_id", "ids").mapInArrow(run, kind)
