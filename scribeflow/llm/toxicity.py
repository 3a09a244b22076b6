"""Operator 1: toxicity by FTRL-proximal logistic regression on hashed word features.

Features are the presence of lower-cased words, word stems (the first 4 to 8
bytes), word pairs and skip-grams (a word and the next but one), hashed
to 2**BITS places. Training keeps per-coordinate rates and an L1 penalty, so
that the weights that remain are few; at most 2**BITS of them, they are
broadcast, and every task scores whole texts with them.

A fifth of the training sample isn't trained on; it shifts the intercept so that
the fixed threshold parts the classes best. The classifier is fitted on a bounded sample of labelled rows (sample rows,
those with the smallest hash of their id, and SAMPLE_CHARS characters), in one task of that bounded size.

Defined cases: a null or empty text gets the score of the intercept alone; very
long texts are scored whole, in runs;
without labelled rows the score is 0.5 everywhere and nothing is rejected;
labels that are null or have no document are ignored; of repeated labels of a
document the largest counts; repeated rows are scored each; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, chars

BITS = 20
#: Labelled rows that training uses at most.
SAMPLE = 12_000
#: Characters of their texts that it uses at most: rows beyond, in the order of the sample, are left out.
SAMPLE_CHARS = 60_000_000
THRESHOLD = 0.7
_CHARS = 500_000


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the texts and the text that each belongs to (repeats kept)."""
    low, starts, lengths, at = chars.word_spans(texts, punctuation=True)
    kinds = chars.prefix_hashes(low, starts, lengths, (None, 4, 5, 6, 7, 8))
    who = np.repeat(np.arange(len(texts)), np.diff(at))
    h, cut = kinds[0], chars._U64(64 - BITS)
    places, owners = [], []
    with np.errstate(over="ignore"):
        for i, k in enumerate(kinds):
            places.append((k * (chars.M2 + chars._U64(2 * i)) >> cut).astype(np.int32))
            owners.append(who)
        for gap in (1, 2):
            same = np.flatnonzero(who[gap:] == who[:-gap]) if len(who) > gap else np.zeros(0, np.int64)
            pair = chars.mix(h[same] * chars._U64(2 * gap + 1) + (h[same + gap] ^ chars.GOLD) * chars.M1)
            places.append((pair >> cut).astype(np.int32))
            owners.append(who[same])
    return np.concatenate(places), np.concatenate(owners)


def train(examples: list[tuple[np.ndarray, int]], rate: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct places, label) in the given order: places and weights that remain, and the intercept."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = min(0.99, max(0.01, np.mean([y for _, y in examples]))) if examples else 0.5
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / rate + l2)

    for _ in range(epochs):
        for places, y in examples:
            zi, ni = z[places], n[places]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, bias + w.sum()))))
            g = p - y
            more = np.sqrt(ni + g * g)
            z[places] = zi + g - (more - np.sqrt(ni)) / rate * w
            n[places] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * rate * g / (beta + bias_n**0.5)
    w = weight(z, n)
    keep = np.flatnonzero(w)
    return keep.astype(np.int32), w[keep], bias


def cut_point(logits: np.ndarray, y: np.ndarray) -> float | None:
    """Where to part the classes: the middle of the widest gap of those with the best F1. None if one class is absent."""
    if not 0 < y.sum() < len(y):
        return None
    order = np.argsort(logits)
    logits, y = logits[order], y[order]
    above = np.cumsum(y[::-1])[::-1]  # positives from here up
    f1 = 2 * above / (np.arange(len(y), 0, -1) + y.sum())
    f1[1:][np.diff(logits) <= 0] = 0  # no cut between equal scores
    gap = np.diff(logits, prepend=logits[0] - 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = best[np.argmax(gap[best])]
    return float(logits[i] - gap[i] / 2)


def train_calibrated(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Trained on four fifths; the rest sets the intercept so that THRESHOLD parts the classes best."""
    part = max(1, len(examples) // 5)
    rest, own = examples[:part], examples[part:]
    places, weights, bias = train(own)
    dense = np.zeros(1 << BITS)
    dense[places] = weights
    cut = cut_point(np.array([bias + dense[x].sum() for x, _ in rest]), np.array([y for _, y in rest])) if own else None
    if cut is not None:
        bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return places, weights, bias


def _spans(texts: list):
    return chars.word_spans(texts, punctuation=True)


def features(texts: list, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of each text (those that wanted marks) and the text that each belongs to.

    One very long text is worked through in runs, each with the two words before it, so that no pair is lost.
    """
    held, before = np.zeros(0, np.int64), ""
    for part in chars.rounds(texts, _CHARS):
        places, owners = hashed([before + part[0]] if before else part)
        keep = slice(None) if wanted is None else np.flatnonzero(wanted[places])
        held = np.union1d(held, owners[keep] * (1 << BITS) + places[keep])
        before = chars.tail(part[0], 2, _spans) if len(texts) == 1 and part[0] else ""
    return held & ((1 << BITS) - 1), held >> BITS


def scores(texts: list, model: np.ndarray, bias: float) -> np.ndarray:
    """model: dense weights of all places."""
    places, owners = features(texts, model != 0)
    total = bias + np.bincount(owners, model[places], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """The model of a bounded sample of the labelled documents."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    kind, out = arrow.schema(None, "place int, weight double")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, size = [], 0
        for b in batches:
            texts, labels = [], []
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                size += len(x.as_py() or "")
                if size <= SAMPLE_CHARS or not (examples or texts):
                    texts.append(x.as_py())
                    labels.append(int(y > 0))
            for i, j in chars.blocks(texts, _CHARS):  # one array a block, of which the examples are parts
                found, owners = features(texts[i:j])
                ends = np.searchsorted(owners, np.arange(j - i + 1))
                found = found.astype(np.int32)
                examples += [(found[ends[k] : ends[k + 1]], labels[i + k]) for k in range(j - i)]
        places, weights, bias = train_calibrated(examples)
        yield arrow.batch(out, np.append(places, -1).astype(np.int32), np.append(weights, bias))

    # one task, of at most sample rows: the learner is sequential; sorted by hash, so the order is the same everywhere
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text").select("text", "y").mapInArrow(run, kind).toArrow()
    places, weights = model.column(0).to_numpy(), model.column(1).to_numpy()
    bias = float(weights[places == -1].sum()) if len(places) else 0.0
    return places[places >= 0], weights[places >= 0], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind, out = arrow.schema(None, "doc_id long, score double, predicted int")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[places] = weights
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chars.blocks(texts, _CHARS):
                got = scores(texts[i:j], dense, bias)
                yield arrow.batch(out, b.column(0)[i:j], got, (got >= THRESHOLD).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """docs without the rows whose text scores THRESHOLD or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list[bool]:
        places, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[places] = weights
        return [bool(s < THRESHOLD) for i, j in chars.blocks(texts, _CHARS) for s in scores(texts[i:j], dense, bias)]

    return arrow.filtered(docs, text, keep)
