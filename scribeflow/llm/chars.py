"""Text as numpy arrays: words, pre-tokens and their 64-bit hashes for many texts at once.

Per-character Python loops are the slow path; these helpers lay a batch of
texts out as one array and find boundaries and hashes with array operations.
All hashes depend on the text alone, never on the batch it came in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64)) * M1


def _pow(n: int) -> np.ndarray:
    return _powers(1 << max(6, int(n - 1).bit_length()))


@cache
def _symbols() -> np.ndarray:
    """A random 64-bit value for each byte or low code point."""
    return mix(np.arange(1, 1 << 16, dtype=np.uint64) * GOLD)


def prefix_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, caps: tuple[int | None, ...]) -> list[np.ndarray]:
    """For each cap, a hash of each non-overlapping span [start, start + length) of values, cut to cap (None: whole).

    values: uint8 bytes or uint32 code points; spans ascend. Position inside the span counts, so order matters.
    """
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(caps)
    first = np.zeros(len(values), np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    inside = np.arange(len(values), dtype=np.int64) - first
    if values.dtype == np.uint8:
        v = _symbols()[values]
    else:
        v = mix((values.astype(np.uint64) + np.uint64(1)) * GOLD)
    v = v * _pow(int(inside.max()) + 1)[inside]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    out = []
    for cap in caps:
        n = lengths if cap is None else np.minimum(lengths, cap)
        out.append(mix(total[starts + n] - total[starts] + n.astype(np.uint64) * GOLD))
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return prefix_hashes(values, starts, lengths, (None,))[0]


def blocks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit characters each; a longer text is a range of its own."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x is not None else 0
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


_SAFE = re.compile(r"\S(?=[\x20\x09-\x0D])")


def runs(text: str, limit: int) -> Iterator[str]:
    """text in parts of about limit characters, cut only before white space that follows something else; '' has none."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def rounds(texts: list, limit: int) -> Iterator[list]:
    """texts, or, of one text above limit alone, its runs one by one: what a block of texts is worked through in."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > limit:
        for part in runs(texts[0], limit):
            yield [part]
    else:
        yield texts


def tail(text: str, n: int, spans) -> str:
    """The shortest end of text from white space on that has n words by spans (word_spans or the like); all of it if it has fewer."""
    k = n
    while True:
        parts = text.rsplit(None, k)
        if len(parts) <= k:
            return text
        end = text[len(parts[0]) :]
        if spans([end])[3][1] >= n:
            return end
        k *= 2


@cache
def _lower(punctuation: bool) -> np.ndarray:
    """Each byte's lower case, or a blank for white space (and for ASCII punctuation, if it parts words)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    if punctuation:
        for a, b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
            t[a:b] = 32
    return t


def word_spans(texts: list, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and length of each word, and each text's first word (n + 1 offsets).

    Words are [^\\x20\\x09-\\x0D]+; with punctuation, ASCII punctuation parts them too. None has no words.
    """
    raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    low = _lower(punctuation)[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff((low == 32).view(np.int8), prepend=1))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0] + [len(x) + 1 for x in raw])
    return low, starts, ends[: len(starts)] - starts, np.searchsorted(starts, at)


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and each text's first word (n + 1 offsets)."""
    low, starts, lengths, at = word_spans(texts)
    return span_hashes(low, starts, lengths), at


#: Scripts that set no blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, kana, bopomofo, Han.
UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
#: Their blanks and punctuation.
_BREAKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


@cache
def _unspaced() -> np.ndarray:
    """Of each code point: 1 for a character of an unspaced script, 2 for what parts words there."""
    t = np.zeros(1 << 21, np.uint8)
    for k, ranges in ((1, UNSPACED), (2, _BREAKS)):
        for a, b in ranges:
            t[a : b + 1] = k
    return t


def symbol_spans(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_spans with punctuation, but each character of an unspaced script is a span of its own, and punctuation of such scripts parts too."""
    low, starts, lengths, at = word_spans(texts, punctuation=True)
    lead = np.flatnonzero(low >= 0xE0)  # of characters of three and four bytes
    if not len(lead):
        return low, starts, lengths, at
    size = 3 + (low[lead] >= 0xF0)
    code = low[lead].astype(np.int64) & np.where(size == 3, 0x0F, 0x07)
    for j in range(1, 4):
        code = np.where(j < size, code << 6 | low[np.minimum(lead + j, len(low) - 1)] & 0x3F, code)
    kind = _unspaced()[code]
    if not kind.any():
        return low, starts, lengths, at
    for j in range(4):
        low[(lead + j)[(kind == 2) & (j < size)]] = 32
    edge = np.zeros(len(low) + 1, bool)
    edge[lead[kind == 1]] = edge[(lead + size)[kind == 1]] = True
    full = low != 32
    before, after = np.concatenate([[False], full[:-1]]), np.concatenate([full[1:], [False]])
    new = np.flatnonzero(full & (~before | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return low, new, ends - new, np.searchsorted(new, np.append(starts, len(low))[at])


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[_WHITE] = SPACE
    return t


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pretokens(text: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of text and the places where its pre-tokens start.

    The pre-tokens are the matches of public_tokenizers.PATTERN in each of
    the parts that start at cuts (ascending, from 0; parts aren't empty).
    """
    c = codes(text)
    n = len(c)
    if not n:
        return c, np.zeros(0, np.int64)
    k = classes()[c]
    part = np.zeros(n + 1, bool)
    part[cuts[cuts < n]] = True
    part[n] = True
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    new |= part[:n]
    # the last white space of a run before something else: alone, or, if it is a blank, with what follows
    last = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & ~part[1:n]) if n > 1 else np.zeros(0, np.int64)
    new[last] = True
    blank = last[c[last] == 32]
    new[blank + 1] = False
    # contractions: an apostrophe that starts a match, and its letters
    q = np.flatnonzero((c == 39) & new)
    q = q[q + 1 < n]
    q = q[(k[q + 1] == LETTER) & ~part[q + 1]]
    if len(q):
        a = c[q + 1]
        two = q + 2 < n
        b = np.where(two & ~part[np.minimum(q + 2, n)], c[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(a, [ord(x) for x in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((short, 2), (long, 3)):
            p = q[hit]
            new[p + 1] = False
            p = p[p + size < n]
            new[p + size] = True
    return c, np.flatnonzero(new)
