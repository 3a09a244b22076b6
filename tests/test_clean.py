"""Cleaning: the six reference cases, the guards around thresholds, and a plain loop as a model."""

import random

from scribeflow.operators import clean

DDL = "episode_id string, seq long, start_ms long, end_ms long, text string"


def rows(texts, zero=()):
    return [("e", i, i * 1000, i * 1000 + (0 if i in zero else 900), t) for i, t in enumerate(texts)]


def kept(spark, texts, zero=(), **kw):
    df = clean.clean_segments(spark.createDataFrame(rows(texts, zero), DDL), **kw)
    return [r.text for r in df.orderBy("seq").collect()]


def test_zero_duration_goes(spark):
    assert kept(spark, ["first thing said", "no time at all", "last thing said"], zero={1}) == ["first thing said", "last thing said"]


def test_consecutive_duplicates_collapse_and_later_ones_stay(spark):
    assert kept(spark, ["one two", "one two", "three"]) == ["one two", "three"]
    assert kept(spark, ["one two", "three", "one two"]) == ["one two", "three", "one two"]


def test_loop_goes(spark):
    assert kept(spark, ["a normal line", " ".join(["we went home"] * 5), "another line"]) == ["a normal line", "another line"]


def test_frequent_short_phrase(spark):
    def texts(n):
        out = [f"some unique line number {i}" for i in range(85)]
        for i in range(n):
            out.insert(i * 5, "Thanks.")
        return out

    assert "Thanks." not in kept(spark, texts(15))
    assert "Thanks." not in kept(spark, texts(11))
    assert kept(spark, texts(10)).count("Thanks.") == 10


def test_empty(spark):
    assert kept(spark, []) == []


def test_host_name_and_corrections(spark):
    assert kept(spark, ["with the nearly  beard today"]) == ["with the Early Bird today"]
    assert kept(spark, ["a Wolrd of words"], variant="scripts", corrections={"wolrd": "world"}) == ["a world of words"]


def loops(text):
    w = text.lower().split()
    return len(w) >= 12 and any(w[s + i * k : s + (i + 1) * k] == w[s : s + k] for k in range(3, 9) for s in range(len(w) - 4 * k + 1) for i in [1] if all(w[s + j * k : s + (j + 1) * k] == w[s : s + k] for j in range(1, 4)))


def model(texts, zero):
    freq = {}
    for t in texts:
        if len(t.split()) <= 3:
            freq[t.lower()] = freq.get(t.lower(), 0) + 1
    noise = {t for t, n in freq.items() if n > max(2, int(len(texts) * 0.02))}
    out = []
    for i, t in enumerate(texts):
        if i in zero or (out and out[-1] == t) or loops(t) or t.lower() in noise:
            continue
        out.append(t)
    return out


def test_against_a_plain_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        texts = [rng.choice(["a b", "c d e", " ".join(["x y z"] * 4), f"line {rng.randint(0, 9)} of it", "a b c d"]) for _ in range(40)]
        zero = {i for i in range(40) if rng.random() < 0.1}
        assert kept(spark, texts, zero, least=2) == model(texts, zero)


def test_purge_and_gate(spark):
    df = spark.createDataFrame(rows(["long enough text"] * 4 + ["short", "other words here"]), DDL)
    assert [r.text for r in clean.purge_phrases(df, 3, 10).orderBy("seq").collect()] == ["short", "other words here"]
    gate = clean.quality_gate(df, 3, 500, 3, 10).first()
    assert (gate.segments, gate.most_repeats, gate.verdict) == (6, 4, "repeats")
    assert clean.quality_gate(df, 100).first().verdict == "too_few"


def test_guest_start(spark):
    guests = spark.createDataFrame([("e", "Ann Lee")], "episode_id string, guest_name string")
    base = 3_000_000

    def start(parts):
        df = spark.createDataFrame([("e", i, base + a, base + b, t) for i, (a, b, t) in enumerate(parts)], DDL)
        got = clean.guest_start(df, guests).collect()
        return got[0].guest_start_ms - base if got else None

    assert start([(0, 5000, "x"), (5000, 190_000, "song"), (190_000, 195_000, "hello"), (195_000, 199_000, "with ann lee")]) == 195_000
    assert start([(0, 5000, "x"), (5000, 190_000, "song"), (190_000, 195_000, "hello")]) == 190_000
    assert start([(0, 5000, "x"), (5000, 9000, "ANN LEE is here")]) == 5000
    assert start([(0, 5000, "x"), (80_000, 85_000, "after a gap")]) == 80_000
    assert start([(0, 5000, "x")]) == 3_600_000 - base
    assert start([(-10, 5000, "early")]) is None
