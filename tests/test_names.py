"""File names, business names, candidates."""

import pytest
from pyspark.sql import functions as F

from scribeflow.functions import names as N
from scribeflow.functions import text as T
from scribeflow.operators import catalog, entities

SHOW = "Dawn Patrol Hour"
ID = "dawn-patrol-hour_2024-05-02_"
CASES = [
    (f"{ID}07-31-05.mp3", f"{ID}07-31-05"),
    (f"{ID}07-31-05 copy.mp3", f"{ID}07-31-05"),
    ("Dawn Patrol Hour 2024-05-02.mp3", f"{ID}07-30-00"),
    ("Dawn Patrol Hour - 2024-05-02.mp3", f"{ID}07-30-00"),
    ("Dawn Patrol Hour 20240502.mp3", f"{ID}07-30-00"),
    ("Dawn_Patrol_Hour_-_2024-05-02.mp3", f"{ID}07-30-00"),
    ("dawn_patrol_hour-2024-05-02.mp3", f"{ID}07-30-00"),
    ("App Recording 20240502 0815.mp3", f"{ID}08-15-00"),
    ("Input Device Recording 20240502 2051.mp3", f"{ID}20-51-00"),
    ("Podcast Dawn Patrol Hour 20240502.MP3", f"{ID}07-30-00"),
    ("rec_(2024_05_02)_1.mp3", f"{ID}07-30-00"),
    ("rec_(05_02_2024)_1.mp3", f"{ID}07-30-00"),
    ("some/dir/Dawn Patrol Hour 20240502 final.mp3", f"{ID}07-30-00"),
    ("Feb 6 - Dawn Patrol Hour.mp3", "dawn-patrol-hour_2014-02-06_07-30-00"),
    ("Dawn Patrol Hour March 20.mp3", "dawn-patrol-hour_2014-03-20_07-30-00"),
    ("Feb 7 - Dawn Patrol Hour.mp3", None),
    ("unknown.mp3", None),
    (f"{ID}07-31-05.wav", None),
]


def test_pipeline_ids(spark):
    got = spark.createDataFrame([(k,) for k, _ in CASES], "k string").select("k", N.recording_id(F.col("k"), SHOW).alias("i")).collect()
    assert {r.k: r.i for r in got} == dict(CASES)


def test_script_ids_differ(spark):
    cases = {"rec_20240502_0815.mp3": f"{ID}07-30-00", "Dawn Patrol Hour 2024-05-02.mp3": "Dawn Patrol Hour 2024-05-02", "odd.name.mp3": "odd.name", "Jan 9 - Dawn Patrol Hour.mp3": "Jan 9 - Dawn Patrol Hour"}
    got = spark.createDataFrame([(k,) for k in cases], "k string").select("k", N.recording_id(F.col("k"), SHOW, "scripts").alias("i")).collect()
    assert {r.k: r.i for r in got} == cases


@pytest.mark.parametrize("raw, want", [
    ("  Blue Door ", "blue door"), ("Blue Door Inc", "blue door"), ("Blue Door Inc.", "blue door"), ("Blue Door LLC", "blue door"), ("Blue Door Corp.", "blue door"), ("Blue Door Corp", "blue door"),
    ("Blue Door Co", "blue door"), ("Blue Door Ltd", "blue door"), ("Blue Door LP", "blue door"), ("Blue   Door", "blue door"), ("Blue Door SF", "blue door"), ("Blue Door San Francisco", "blue door"),
    ("Blue Door san  francisco", "blue door"), ("blue door iNc lLc.", "blue door"), ("Incline", "incline"), ("", ""), (None, ""),
])
def test_normalize(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(N.normalize_name(F.col("n"))).first()[0] == want


def test_filter(spark):
    cases = {"ab": True, "abc": False, "123456": True, "12a": False, "The Page": True, "sage": True, "UBER": True, "Sage Hill": False, "": True}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", N.unusable_name(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == cases


def test_merge(spark):
    ddl = "ord long, name string, source string, category string, lat double, lng double"
    data = [(1, "Blue Door", "a", "bar", None, 1.0), (2, "BLUE DOOR Inc", "b", "cafe", 2.0, 3.0), (3, "blue door", "a", "bar", 4.0, 5.0), (4, "Other", "b", None, None, None)]
    got = {r.normalized_name: r for r in entities.merge_candidates(spark.createDataFrame(data, ddl)).collect()}
    b = got["blue door"]
    assert (b.name, b.source, b.sources, b.category, b.categories, b.lat, b.lng) == ("Blue Door", "a", ["a", "b"], "bar", ["bar", "cafe"], 2.0, 3.0)
    assert (got["other"].categories, got["other"].lat) == ([], None)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _pairs(names, percent):
    return {(a, b) for a in names for b in names if a < b and abs(len(a) - len(b)) <= 9 and (1 - _distance(a, b) / max(len(a), len(b))) * 100 >= percent - 1e-9}


@pytest.mark.parametrize("percent, hot", [(85, 1000), (85, 2), (75, 5), (90, 1)])
def test_similar_names_equal_all_pairs(spark, percent, hot):
    import random

    rng = random.Random(2)
    names = {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() for _ in range(120)} | {"maria lopez", "maria lopes", "mario lopez", "x"} - {""}
    names |= {"the very long name of a place by the sea " + "".join(rng.choice("ab") for _ in range(4)) for _ in range(20)}  # too long for shortened forms
    names = sorted(n for n in names if n)
    if percent == 75:
        names = [n for n in names if len(n) >= 2]  # a name shorter than a run meets none
    got = {(r.a, r.b) for r in entities.similar_names(spark.createDataFrame([(n,) for n in names], "guest_name string"), percent=percent, hot=hot).collect()}
    assert got == {p for p in _pairs(names, percent) if min(map(len, p)) >= 3 or percent == 75}


def test_names_that_share_every_run(spark):
    """Numbered names: what is compared stays within a multiple of what is alike, where all share their runs."""
    names = [f"guest number {i:03d} of it" for i in range(0, 1000, 3)]
    df = spark.createDataFrame([(n,) for n in names], "guest_name string")
    got = {(r.a, r.b) for r in entities.similar_names(df, percent=90, hot=20).collect()}
    assert got == _pairs(names, 90)
    forms = entities._shortened(df.select(F.col("guest_name").alias("k"), F.length("guest_name").alias("n"), F.lit(2).alias("most")))
    meet = forms.alias("x").join(forms.alias("y"), "form").where("x.k < y.k").select("x.k", "y.k").distinct().count()
    assert meet <= 3 * len(got)


def test_mentions(spark):
    names = spark.createDataFrame([("a.b",), ("end",), ("c++ day",)], "name string")
    segs = spark.createDataFrame([("e", 1, "see A.B now"), ("e", 2, "axb end."), ("e", 3, "bend"), ("e", 4, "a c++ day out"), ("e", 5, "enden")], "episode_id string, seq long, text string")
    assert {(r.name, r.seq) for r in entities.mentions(names, segs).collect()} == {("a.b", 1), ("end", 2), ("c++ day", 4)}


def test_mentions_equal_all_pairs(spark):
    """Names with and without ASCII words against a plain pattern over all pairs."""
    import random
    import re

    rng = random.Random(4)
    parts = ["the", "end", "a", "B", "日本", "é", "&", "+", ".", " ", " ", "-", "x", "C++", "end."]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    names = sorted({make(4) for _ in range(80)} | {"日本", "&", "é", "the end"})
    segs = [("e", i, make(14)) for i in range(150)] + [("e", 900, "x日本y"), ("e", 901, "a&b"), ("e", 902, "")]
    got = {(r.name, r.seq) for r in entities.mentions(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(segs, "episode_id string, seq long, text string")).collect()}
    want = {(n, i) for n in names for _, i, t in segs if re.search(rf"\b{re.escape(n)}\b", t, re.I | re.A)}
    assert got == want and {("日本", 900), ("&", 901)} <= want


def test_longer_names_equal_all_pairs(spark):
    import random

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 7))) for _ in range(150)} | {"ab", "abc", "abcd", "x", "yx", "the one", "the one more"})
    got = {r[0] for r in entities.longer_names_only(spark.createDataFrame([(n,) for n in names], "normalized_name string")).collect()}
    assert got == {a for a in names if not any(a in b and a != b for b in names)}


def test_similar_names_of_one_beginning(spark):
    """Names that share all but a few letters, and spellings of one name; below 75 % it refuses."""
    names = [f"customer number {i:05d}" for i in range(0, 3000, 7)] + ["Ada L", "ADA L", "ada l", "Bo", "bo", "b"]
    got = {(r.a, r.b) for r in entities.similar_names(spark.createDataFrame([(n,) for n in names], "guest_name string")).collect()}
    assert {("ADA L", "Ada L"), ("ADA L", "ada l"), ("Ada L", "ada l"), ("Bo", "bo"), ("customer number 00000", "customer number 00007")} <= got
    assert not any("b" in p for p in got) and all(a < b for a, b in got)
    with pytest.raises(ValueError):
        entities.similar_names(spark.createDataFrame([("a",)], "guest_name string"), percent=70)


def test_places_whose_address_is_not_found(spark):
    plan = spark.createDataFrame([("a", 1.0, 2.0, "insert"), ("b", None, None, "geocode"), ("c", None, None, "geocode"), ("d", None, None, "skip"), ("e", None, None, "link")], "name string, lat double, lng double, plan string")
    found = spark.createDataFrame([("b", 3.0, 4.0)], "name string, lat double, lng double")
    rows = lambda **k: {r.name: (r.lat, r.lng) for r in entities.located(plan, found, **k).collect()}
    assert rows() == {"a": (1.0, 2.0), "b": (3.0, 4.0), "c": entities.CITY_CENTRE}
    assert rows(fallback=None) == {"a": (1.0, 2.0), "b": (3.0, 4.0)}


def test_pending_corrections(spark):
    links = spark.createDataFrame([("1", "Jon"), ("2", "Jon"), ("3", "John"), ("4", "x")], "episode_id string, guest_name string")
    renames = spark.createDataFrame([("Jon", "John"), ("x", "X"), ("gone", "y")], "old string, new string")
    got = sorted(map(tuple, entities.pending_corrections(links, renames, spark.createDataFrame([("x",)], "old string")).collect()), key=str)
    assert got == [("Jon", "John", 2, True), ("x", "X", 1, False), ("x", None, 1, False)]


def test_discovery_prefers_large_then_score(spark):
    files = spark.createDataFrame(
        [("Dawn Patrol Hour 20240502.mp3", 9_000_000), ("Dawn Patrol Hour 20240502 final.mp3", 8_000_000), ("Dawn Patrol Hour 20240502 copy.mp3", 9_900_000), ("Dawn Patrol Hour 20240509.mp3", 10), ("Dawn Patrol Hour 20240509 final.mp3", 5), ("notes.mp3", 9_000_000)],
        "filename string, size long",
    )
    done = spark.createDataFrame([], "recording_id string")
    assert {r.filename for r in catalog.discover(files, done, SHOW).collect()} == {"Dawn Patrol Hour 20240502 final.mp3", "Dawn Patrol Hour 20240509.mp3"}


def test_geocode_cascade(spark):
    from scribeflow import ext

    names = spark.createDataFrame([("Pier 9",), ("Oak & Elm",), ("Ash and Fir",), ("Far Place",), ("Near Place",)], "name string")
    known = spark.createDataFrame(
        [("Pier 9 San Francisco CA", 37.75, -122.4), ("Oak and Elm, San Francisco", 1.0, 2.0), ("Ash, San Francisco CA", 3.0, 4.0), ("Far Place San Francisco CA", 10.0, 10.0)], "query string, lat double, lng double"
    )
    lookup = ext.gazetteer(known)
    bounded = lambda asked: lookup(asked.where("NOT (name = 'Far Place' AND bounded)"))
    got = {r.name: (r.lat, r.lng) for r in entities.geocode_cascade(names, bounded).collect()}
    assert got == {"Pier 9": (37.75, -122.4), "Oak & Elm": (1.0, 2.0), "Ash and Fir": (3.0, 4.0), "Far Place": (None, None), "Near Place": (None, None)}


def test_parsers(spark):
    one = spark.range(1)
    assert one.select(T.json_names(F.lit('```json\n["a", "b"]\n```'))).first()[0] == ["a", "b"]
    assert one.select(T.json_names(F.lit("none found"))).first()[0] == []
    r = one.select(T.summary_reply(F.lit('{"title": "t", "guests": "nobody"}')).alias("r")).first().r
    assert (r.title, r.guests) == ("t", [])
    assert T.search_phrases('a "b*" (c)') == ["a", "b", "c"] and T.tokens_of("Don't") == ["don", "t"]


def test_similar_names_spread_their_pairs(spark, monkeypatch):
    """Few names of one form make many pairs: tasks follow the pairs, and adaptive execution doesn't join them into one."""
    from scribeflow.operators import entities

    monkeypatch.setattr(entities, "PAIRS", 1000)
    names = [f"suppl {i:05d}" for i in range(300)]
    found = entities.similar_names(spark.createDataFrame([(n,) for n in names], "guest_name string"), hot=20)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 4
    one = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1 or sum(x != y for x, y in zip(a, b, strict=True)) == 0
    got = {(r.a, r.b) for r in found.collect()}
    assert {(a, b) for a in names for b in names if a < b and one(a, b)} <= got
