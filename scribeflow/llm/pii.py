"""Operator 10: personal data by candidate gradient boosting.

Base spans come from the fixed patterns below with their checks, and always
stay. High-recall generators then propose further, overlapping spans wherever
no base span stands: card and phone numbers among other digits (a number that
ran into the next one, other separators), quads inside dotted runs, disguised
addresses, and secrets (keys and tokens, a kind of its own). Boosted trees
judge each by its format and its context: the characters around it, what else
is in its run of digits, and the words beside it. A threshold for each kind,
calibrated to a precision on documents not trained on, selects the spans.

No span labels exist, so labels are planted: into passages of sampled
documents go disguised personal data and look-alikes that pass the same checks
(order numbers, ISBNs, versions, object ids, digests, slugs), some after words
that tell. A proposed span is right if it is just what was planted as personal
data, wrong if it touches planted text otherwise; spans elsewhere are no
examples. The checks are no features. Fitted on passages of at most CONTEXT
characters of at most SAMPLE documents (those with the smallest hash of their
id); quality() plants into others and reports precision and recall by kind.

All spans of a kind are sorted and disjoint, so overlaps are found by
bisection; work is linear in the text.

Defined cases: null and empty texts have no spans; without documents to learn
from nothing is added; repeated rows are searched each; equally likely spans
that overlap: the longer, then the first stays; very long texts are searched
whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, boosting, chars

#: The kinds with base patterns, and all kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SAMPLE = 3_000
CONTEXT = 1_500
PRECISION = 0.98
#: Words beside examples whose lean the model keeps.
WORDS = 400

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits that a match at its first digit fails on
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20")
_DOT = r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20"
# after a bracketed sign any domain will do; after the bare word one with a bracketed or spelt dot
_ANY_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+")
_FAR_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:{_DOT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*")
_PLAIN_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){4,}")
_SPLIT_IP = re.compile(r"(?<![0-9])[0-9]+(?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]+(?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]+(?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]+(?![0-9])")
_RUN = re.compile(r"[0-9](?:[\x20.\-/()]{0,3}[0-9])*")
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_NUMBER = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]{2,24}")
_ANY = re.compile(r"[0-9@]|[\[({\x20]at[\])}\x20]", re.I)

Span = tuple[int, int]
Proposal = tuple[str, int, int, int, int]  # kind, start, end, and the digits before and after it in its run


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in _NUMBER.findall(s))


def _phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern: each stands around an @, so only those are looked at."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind."""
    out = {"email": _emails(text)}
    for kind, pattern, check in (("ip", _IP, _ip), ("card", _DIGITS, _card), ("phone", _PHONE, _phone)):
        out[kind] = [m.span() for m in pattern.finditer(text) if check(m[0])]
    return out


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _touches(covered: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect_right(covered[1], a)
    return i < len(covered[0]) and covered[0][i] < b


def _numbers(text: str) -> Iterator[Proposal]:
    """Card and phone numbers of whole digit groups in any run of groups."""
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in _NUMBER.finditer(run[0])]
        total, before = sum(e - b for b, e in groups), 0
        for i, (a, z) in enumerate(groups):
            n, plus = 0, a > 0 and text[a - 1] == "+"
            for b, e in groups[i : i + 19]:
                n += e - b
                if n > 19:
                    break
                if n >= 13 and luhn(_digits(text[a:e])):
                    yield "card", a, e, before, total - before - n
                if plus and 9 <= n <= 15:
                    yield "phone", a - 1, e, before, total - before - n
            before += z - a


def candidates(text: str, base: dict[str, list[Span]]) -> list[Proposal]:
    """Spans for the model to judge: those of the generators that touch no base span, each once, sorted."""
    out = set(_numbers(text))
    out.update(("phone", *m.span(), 0, 0) for m in _PLAIN_PHONE.finditer(text))
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in _NUMBER.finditer(m[0])]
        for i in range(len(parts) - 3):
            a, b = m.start() + parts[i][0], m.start() + parts[i + 3][1]
            if _ip(text[a:b]):
                out.add(("ip", a, b, i, len(parts) - 4 - i))
    out.update(("ip", *m.span(), 0, 0) for m in _SPLIT_IP.finditer(text) if _ip(m[0]))
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = (_FAR_DOMAIN if m[0].strip(" ").lower() == "at" else _ANY_DOMAIN).match(text, m.end())
        free = m.end()
        if domain and start < m.start():
            out.add(("email", start, domain.end(), 0, 0))
    for m in _SECRET.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.add(("secret", *m.span(), 0, 0))
    covered = _covered([s for spans in base.values() for s in spans])
    return sorted(c for c in out if not _touches(covered, c[1], c[2]))


_CLASS = {**dict.fromkeys("0123456789", 1), " ": 2, **dict.fromkeys("\t\n\r", 3), **dict.fromkeys(".,;!?", 4), **dict.fromkeys("()[]{}<>", 5), "+": 6, "-": 7, "@": 8, ":": 9, "=": 10, "/": 11, '"': 12, "'": 12, "_": 13, "#": 14}


def _class(c: str) -> int:
    return 0 if not c else _CLASS.get(c, 15 if c.isalpha() else 16)


def beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The last word before and the first after a span, lower-cased, '' without one nearby."""
    words = _WORD.findall(text[max(0, a - 32) : a])
    after = _WORD.search(text[b : b + 32])
    return words[-1].lower() if words else "", after[0].lower() if after else ""


def features(text: str, c: Proposal, lean: dict[str, float]) -> list[float]:
    kind, a, b, before, after = c
    s = text[a:b]
    n = len(s)
    groups = [len(g) for g in _NUMBER.findall(s)] or [0]
    letters, upper = sum(x.isalpha() for x in s), sum(x.isupper() for x in s)
    inner = {x for x in s if not x.isalnum()}
    swaps = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    counts = Counter(s)
    left, right = beside(text, a, b)
    near = text[max(0, a - 4) : a]
    return [
        KINDS.index(kind), n, sum(groups), len(groups), groups[0], groups[-1], max(groups), min(groups), int(s[0]) if s[0].isdigit() else -1,
        s.startswith("+"), "(" in s, "-" in inner, "." in inner, " " in inner, "/" in inner, "_" in inner, len(inner), before, after,
        _class(text[a - 1 : a]), _class(text[b : b + 1]), _class(text[a - 2 : a - 1]), _class(text[b + 1 : b + 2]), "=" in near or ":" in near,
        letters / n, upper / max(1, letters), swaps / n, all(x in "0123456789abcdefABCDEF" for x in s), -sum(k / n * math.log2(k / n) for k in counts.values()),
        max(map(len, re.split(r"[^A-Za-z]+", s))), lean.get(left, 0.0), lean.get(right, 0.0),
    ]


# ---- planted examples


def _pick(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _card_number(rng: random.Random) -> str:
    d = rng.choice("3456") + _pick(rng, "0123456789", rng.choice([14, 14, 14, 13]))
    return next(d + c for c in "0123456789" if luhn(d + c))


_HEX, _ALNUM, _LOW = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
_CUES = {"email": ("mail", "email", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"), "phone": ("call", "tel", "phone"), "secret": ("token", "secret", "key")}


def _personal(rng: random.Random) -> list[tuple[str, str]]:
    """Disguised personal data in pieces (kind or '', text)."""
    kind = rng.choice(KINDS)
    card, area = _card_number(rng), f"{rng.randint(200, 989)}"
    fours = [card[i : i + 4] for i in range(0, len(card), 4)]
    shown = rng.choice([card, " ".join(fours), "-".join(fours)])
    phone = rng.choice(["+1 ({a}) {b}-{c}", "+44 {a} {b} {c}", "+{a} {b} {c}"]).format(a=area, b=rng.randint(200, 999), c=rng.randint(1000, 9999))
    quad = [str(rng.randint(1, 255)) for _ in range(4)]
    cue = [("", rng.choice(_CUES[kind]) + rng.choice([" ", ": "]))] if rng.random() < 0.4 else []
    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [@] ", ".")])
        return [*cue, (kind, _pick(rng, _LOW, rng.randint(3, 10)) + rng.choice(["", ".", "_", "7"]) + _pick(rng, _LOW, 3) + at + _pick(rng, _LOW, rng.randint(3, 9)) + dot + rng.choice(["com", "org", "net", "de", "fr", "es"]))]
    if kind == "ip":
        return [*cue, (kind, rng.choice(["[.]", "(.)", "[dot]", " . "]).join(quad))]
    if kind == "phone":
        plain = rng.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}"]).format(a=area, b=rng.randint(200, 999), c=rng.randint(1000, 9999))
        return [*cue, (kind, plain)] if rng.random() < 0.6 else [*cue, (kind, phone), ("", " "), ("card", shown)]
    if kind == "card":
        parted = rng.choice([".", "/", "  ", " - "]).join(fours)
        return [*cue, *rng.choice([[(kind, parted)], [(kind, shown), ("", f" {rng.randint(1, 12):02d}/{rng.randint(24, 39)}")], [("phone", phone), ("", rng.choice([" ", "  "])), (kind, shown)]])]
    value = rng.choice([_pick(rng, _HEX, rng.choice([32, 40, 48, 64])), _pick(rng, _ALNUM, rng.randint(20, 48)), "AKIA" + _pick(rng, _ALNUM[:26] + "0123456789", 16), "ghp_" + _pick(rng, _ALNUM, 36), "sk_live_" + _pick(rng, _ALNUM, 24)])
    name = rng.choice(["token", "api_key", "secret", "password", "key", "auth", "access_token"])
    return [("", rng.choice([f'{name} = "', f"{name}=", f"{name}: ", f'"{name}": "', f"{name.upper()}='", "Authorization: Bearer "])), (kind, value), ("", rng.choice(['"', "'", ""]))]


def _look_alike(rng: random.Random) -> list[tuple[str, str]]:
    """Harmless text that the generators and checks may take for personal data."""
    number = lambda n: _pick(rng, "123456789", 1) + _pick(rng, "0123456789", n - 1)
    parts = lambda n, most: ".".join(str(rng.randint(0, most)) for _ in range(n))
    stamp = f"20{rng.randint(10, 29)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    words = "-".join(_pick(rng, _LOW, rng.randint(2, 8)) for _ in range(rng.randint(3, 6)))
    return [("", rng.choice([
        f"order {number(rng.randint(20, 26))}", f"order no {number(4)} {number(5)} {number(4)} {number(5)}", f"isbn 978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{stamp} {rng.randint(10, 23)}{number(4)} {number(3)}",
        " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(6, 14))), f"sku {number(3)}-{number(3)}-{number(4)}", f"item {number(3)}.{number(3)}.{number(4)} pcs", f"+{number(2)} {number(3)} {number(4)} %",
        f"version {parts(rng.randint(5, 7), 30)}", f"oid 1.3.6.1.{parts(rng.randint(3, 8), 200)}", f"section {parts(5, 12)}", f"commit {_pick(rng, _HEX, 40)}", f"sha256:{_pick(rng, _HEX, 64)}", f"uuid {_pick(rng, _HEX, 8)}-{_pick(rng, _HEX, 4)}-4{_pick(rng, _HEX, 3)}-a{_pick(rng, _HEX, 3)}-{_pick(rng, _HEX, 12)}",
        f"/{words}-{number(4)}", f"IMG_{stamp}_{number(9)}.jpg", f"data:image/png;base64,{_pick(rng, _ALNUM + '+/', rng.randint(40, 90))}", f"look at {_pick(rng, _LOW, 5)} and {_pick(rng, _LOW, 6)}", f"page at {_pick(rng, _LOW, 6)}.com", f"{words}_{number(2)}", f"etag {_pick(rng, _HEX, 32)}",
    ]))]


def planted(text: str, seed: int, most: int = 6) -> tuple[str, set[tuple[str, int, int]], list[Span]]:
    """A passage of text with planted pieces: it, the personal data among them, and where pieces stand."""
    rng = random.Random(seed)
    at = rng.randrange(max(1, len(text) - CONTEXT))
    text = text[at : at + CONTEXT]
    gaps = [m.start() for m in re.finditer(r"\x20", text)]
    out, gold, regions, done, size = [], set(), [], 0, 0
    for gap in sorted(rng.sample(gaps, min(most, len(gaps)))):
        out.append(text[done:gap] + " ")
        size, done = size + gap - done + 1, gap
        first = size
        for kind, s in _personal(rng) if rng.random() < 0.5 else _look_alike(rng):
            if kind:
                gold.add((kind, size, size + len(s)))
            out.append(s)
            size += len(s)
        regions.append((first, size))
    return "".join(out) + text[done:], gold, regions


Model = tuple[tuple, dict[str, float], dict[str, float]]  # trees, thresholds, leanings of words


def examples(text: str, seed: int) -> list[tuple[str, Proposal, int]]:
    """(text with planted pieces, proposed span, label) of the spans that touch a piece."""
    full, gold, regions = planted(text, seed)
    covered = _covered(regions)
    return [(full, c, int(c[:3] in gold)) for c in candidates(full, base_spans(full)) if _touches(covered, c[1], c[2])]


def leanings(words: list[tuple[str, str]], y: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of the most frequent words beside examples, before or after."""
    seen, good = Counter(), Counter()
    for pair, label in zip(words, y, strict=True):
        for w in set(pair) - {""}:
            seen[w] += 1
            good[w] += label
    share = float(np.mean(y)) if len(y) else 0.5
    odds = lambda p: math.log(p / (1 - p))
    most = sorted(seen, key=lambda w: (-seen[w], w))[:WORDS]
    return {w: odds((good[w] + 10 * share) / (seen[w] + 10)) - odds(share) for w in most} if 0 < share < 1 else {}


def fit_examples(rows: list[tuple[str, Proposal, int]], part: np.ndarray) -> Model | None:
    """Words, trees and thresholds, each on its own third of the documents (part: 0, 1, 2); None without both labels."""
    y = np.array([label for *_, label in rows], float)
    if not len(rows) or any(not 0 < y[part == p].sum() < (part == p).sum() for p in (0, 1, 2)):
        return None
    lean = leanings([beside(t, c[1], c[2]) for (t, c, _), p in zip(rows, part, strict=True) if p == 0], y[part == 0])
    x = np.array([features(t, c, lean) for t, c, _ in rows], float)
    trees = boosting.train(x[part == 1], y[part == 1])
    p = boosting.probabilities(trees, x[part == 2])
    limits = {}
    for i, kind in enumerate(KINDS):
        own = x[part == 2][:, 0] == i
        q, z = p[own], y[part == 2][own]
        order = np.argsort(-q, kind="stable")
        good = np.cumsum(z[order]) / np.arange(1, len(z) + 1) >= PRECISION
        ends = np.append(np.diff(q[order]) < 0, True)[: len(z)]  # a threshold takes all equal scores
        fit_ = np.flatnonzero(good & ends)
        limits[kind] = max(0.5, float(q[order][fit_[-1]])) if len(fit_) else 2.0
    return trees, limits, lean


def added_spans(texts: list[str], proposed: list[list[Proposal]], model: Model | None) -> list[list[tuple[str, int, int]]]:
    """The best non-overlapping spans of each kind that the model selects in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    ask = [(i, c) for i, own in enumerate(proposed) for c in own]
    if not model or not ask:
        return out
    p = np.concatenate([boosting.probabilities(model[0], np.array([features(texts[i], c, model[2]) for i, c in ask[k : k + 20_000]], float)) for k in range(0, len(ask), 20_000)])
    taken: dict[tuple[int, str], list[Span]] = {}
    for j in sorted(range(len(ask)), key=lambda j: (-p[j], ask[j][1][1] - ask[j][1][2], j)):
        i, (kind, a, b, *_) = ask[j]
        if p[j] < model[1][kind]:
            continue
        own = taken.setdefault((i, kind), [])
        k = bisect_left(own, (a, b))
        if (k == 0 or own[k - 1][1] <= a) and (k == len(own) or own[k][0] >= b):
            insort(own, (a, b))
            out[i].append((kind, a, b))
    return out


#: Characters of texts that are searched at once, about; a longer text is searched by itself.
_CHARS = 1_000_000
Found = tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]


def find_all(texts: list, model: Model | None) -> list[Found]:
    """Base spans and all spans of each text, by kind and start."""
    bases = [base_spans(x) if x and _ANY.search(x) else None for x in texts]
    full = [x or "" for x in texts]
    more = added_spans(full, [candidates(x, b) if model and b is not None else [] for x, b in zip(full, bases, strict=True)], model)
    out = []
    for b, extra in zip(bases, more, strict=True):
        base = [(k, *s) for k in BASE for s in b[k]] if b else []
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def find(text: str | None, model: Model | None) -> Found:
    return find_all([text], model)[0]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with each span (overlapping ones as one) replaced by the name of its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def _sampled(docs: DataFrame, text: str, sample: int, skip: int = 0) -> list[tuple[int, str]]:
    """(id, passage) of the documents with the smallest hashes of their ids, from the skip-th on; only ids are sorted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ids = rows.where("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").offset(skip).limit(sample)
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.lit(1), F.length("text") - CONTEXT)) + 1
    passage = F.substring(F.col("text"), place.cast("int"), F.lit(CONTEXT))
    own = rows.where("text IS NOT NULL").join(F.broadcast(ids), "id").select("id", passage.alias("passage"))  # sample ids
    got = own.groupBy("id").agg(F.min("passage").alias("passage")).collect()  # a passage for each sampled id
    return sorted((r["id"], r["passage"]) for r in got)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model, from pieces planted into passages of a bounded sample of documents."""
    rows, part = [], []
    for i, x in _sampled(docs, text, sample):
        got = examples(x, i)
        rows += got
        part += [(i * 2654435761 % (1 << 32) >> 8) % 3] * len(got)
    return fit_examples(rows, np.array(part))


def quality(docs: DataFrame, model: Model, text: str = "text", sample: int = 1_000, skip: int = SAMPLE) -> dict[str, tuple[int, int, int]]:
    """By kind: planted, added and rightly added spans, in passages of documents that fit() didn't see."""
    asked, got, right = Counter(), Counter(), Counter()
    cases = [planted(x, i) for i, x in _sampled(docs, text, sample, skip)]
    for (full, gold, regions), (base, every) in zip(cases, find_all([c[0] for c in cases], model), strict=True):
        covered, old = _covered(regions), set(base)
        new = {s for s in every if s not in old and _touches(covered, s[1], s[2])}
        for count, spans in ((asked, gold - old), (got, new), (right, new & gold)):
            count.update(k for k, *_ in spans)
    return {k: (asked[k], got[k], right[k]) for k in KINDS}


def spans(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) and redacted (the text without them) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind: string, start: int, end: int>>"
    kind, out = arrow.schema(None, f"doc_id long, base {span}, spans {span}, redacted string")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            as_rows = lambda s: [dict(zip(("kind", "start", "end"), x, strict=True)) for x in s]
            every = b.column(1).to_pylist()
            for i, j in chars.blocks(every, _CHARS):
                texts = every[i:j]
                got = find_all(texts, own)
                yield arrow.batch(out, b.column(0)[i:j], [as_rows(a) for a, _ in got], [as_rows(z) for _, z in got], [redact(x, z) for x, (_, z) in zip(texts, got, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def digest(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all, as text) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind, out = arrow.schema(None, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            as_text = lambda s: ",".join(f"{k}:{a}:{z}" for k, a, z in s)
            texts = b.column(1).to_pylist()
            for i, j in chars.blocks(texts, _CHARS):
                got = find_all(texts[i:j], own)
                counts = [[sum(k == kk for kk, *_ in base) for base, _ in got] for k in BASE]
                yield arrow.batch(out, b.column(0)[i:j], *counts, [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in got], [as_text(z) for _, z in got])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def redacted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with the personal data of each text replaced by the names of its kinds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def change(texts: list) -> list:
        parts = (texts[i:j] for i, j in chars.blocks(texts, _CHARS))
        return [redact(x, z) for part in parts for x, (_, z) in zip(part, find_all(part, shared.value), strict=True)]

    return arrow.replaced(docs, text, change)
