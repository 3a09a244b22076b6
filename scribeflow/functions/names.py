"""Names of recordings, businesses and places."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates of the recordings whose file names give month and day alone. Fixed values.
MONTH_DAYS_PIPELINE = {
    "jan 9": "2014-01-09", "jan 13": "2014-01-13", "jan 16": "2014-01-16", "jan 23": "2014-01-23", "jan 30": "2014-01-30",
    "feb 6": "2014-02-06", "feb 13": "2014-02-13", "feb 18": "2014-02-18", "feb 26": "2014-02-26",
    "march 6": "2014-03-06", "march 13": "2014-03-13", "march 20": "2014-03-20", "march 27": "2014-03-27",
    "april 3": "2014-04-03", "april 10": "2014-04-10", "april 17": "2014-04-17", "april 24": "2014-04-24",
}
MONTH_DAYS_SCRIPTS = {
    "jan 30": "2014-01-30", "feb 6": "2014-02-06", "march 6": "2014-03-06", "march 13": "2014-03-13",
    "march 20": "2014-03-20", "april 17": "2014-04-17", "april 24": "2014-04-24",
}
#: Suffixes that mark a corporation. Fixed values.
CORPORATE = (" llc", " inc", " inc.", " corp", " corp.", " ltd", " ltd.", " llp", " lp", " co.", " pllc", " pc", " p.c.", " dba", " gp")
#: Words of food, drink and culture that make a match likely. Fixed values.
CULTURE_WORDS = (
    "cafe", "café", "coffee", "bakery", "restaurant", "bar", "grill", "pizza", "taqueria", "brewery", "brewing", "deli", "bistro", "kitchen", "eatery",
    "tavern", "pub", "saloon", "lounge", "cocktail", "wine", "beer", "ice cream", "gelato", "donut", "bagel", "burrito", "taco", "sushi", "ramen", "noodle",
    "dim sum", "dumpling", "pho", "thai", "diner", "brunch", "roast", "roaster", "bookstore", "books", "records", "vinyl", "gallery", "theater", "theatre",
    "music", "club", "venue", "market", "grocer", "butcher", "fish", "seafood",
)
#: Names too general to be places. Fixed values.
PLACE_STOPLIST = (
    "the page", "amber", "grace", "maven", "slate", "the social", "the vault", "the mint", "urban", "nova", "the ramp", "sage", "the corner", "local",
    "the plant", "the mill", "the grove", "the square", "bon", "reed", "the den", "the net", "rogue", "the marsh", "the line", "the center",
    "the shop", "the bar", "haven", "the hall", "the bay", "native", "pearl", "the start", "standard", "the independent", "the market", "noble",
    "anthony", "irving", "lyft", "uber", "meta", "stripe",
)
#: Places that need no verification. Fixed values.
KNOWN_PLACES = (
    "mission district", "dolores park", "ocean beach", "golden gate park", "twin peaks", "bernal hill", "market street", "valencia street",
    "ferry building", "castro", "haight-ashbury", "the sunset", "inner richmond", "outer richmond", "dogpatch", "soma", "tenderloin",
    "civic center", "north beach", "chinatown", "presidio", "lands end", "baker beach", "coit tower", "transamerica pyramid", "sutro tower",
    "alamo square",
)
#: A file below this size is likely a fragment.
SMALL_FILE = 5 * 1024 * 1024


def strip_articles(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)^(the|a|an)\s+", ""))


def normalize_name(c: Column) -> Column:
    """Trimmed, without corporate and city endings (any number of them), single blanks, lower case."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)(\s+(inc|llc|corp|co|ltd|lp|sf|san\s+francisco)\.?)+$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def unusable_name(c: Column, stoplist: tuple[str, ...] = PLACE_STOPLIST) -> Column:
    """Two characters or fewer, digits alone, or on the stop-list."""
    name = F.coalesce(c, F.lit(""))
    return (F.length(name) <= 2) | name.rlike("^[0-9]+$") | F.lower(name).isin(*stoplist)


def corporate(c: Column) -> Column:
    return reduce(lambda a, s: a | F.lower(c).endswith(s), CORPORATE, F.lit(False))


def has_culture_word(c: Column) -> Column:
    return F.lower(c).rlike("|".join(CULTURE_WORDS))


def skip_reason(c: Column, blocked: Column) -> Column:
    """Why a business name isn't searched: short, corp, blocked (the first that holds), or null. blocked: array of names."""
    bare = strip_articles(c)
    return F.when(F.length(bare) < 4, "short").when(corporate(c), "corp").when(F.array_contains(blocked, c) | F.array_contains(blocked, bare), "blocked")


def confidence(name: Column, episodes: Column) -> Column:
    """skip, high or medium, by culture words and the number of episodes that match."""
    food = has_culture_word(name)
    return F.when(episodes > 100, "skip").when((episodes > 50) & ~food, "skip").when(food, "high").otherwise("medium")


def file_score(c: Column) -> Column:
    """Preference among files of one date."""
    low = F.lower(c)
    part = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        part(low.contains("final") | low.contains("_full"), 100)
        + part(low.contains("copy") | low.rlike(r"\([0-9]+\)"), -50)
        + part(low.startswith("podcast "), -10)
        + part(low.rlike(r"\s[0-9]\.mp3$"), -20)
    )


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def sort_minutes(c: Column, slug: str) -> Column:
    """Minutes since midnight that a file name gives, or null."""
    s = stem(c)
    out = []
    for p in (r"(?i)App[_ ]Recording[_ ]+\d{8}[_ ]+(\d{2})(\d{2})", r"(?i)Input Device Recording\s+\d{8}\s+(\d{2})(\d{2})", rf"(?i)^{slug}_\d{{4}}-\d{{2}}-\d{{2}}_(\d{{2}})-(\d{{2}})-\d{{2}}$"):
        out.append(F.when(s.rlike(p), F.regexp_extract(s, p, 1).cast("int") * 60 + F.regexp_extract(s, p, 2).cast("int")))
    return F.coalesce(*out)


def recording_id(c: Column, show: str, variant: str = "pipeline") -> Column:
    """The canonical id `<slug>_YYYY-MM-DD_HH-MM-SS` that a file name stands for.

    show: the show's title in words, from which the spellings in file names
    follow. Variant `pipeline` knows .mp3 keys alone and gives null for
    others; variant `scripts` knows other spellings and falls back to the stem.
    """
    words = show.split()
    spaced, slug, under = " ".join(words), "-".join(words).lower(), "_".join(words)
    pipeline = variant == "pipeline"
    key = F.element_at(F.split(c, "/"), -1)
    s = F.regexp_replace(key, r"(?i)\.mp3$", "") if pipeline else stem(c)
    def either(forms: list[str], template: str) -> Column:
        """The id by the first of the forms (with groups y, m, d and perhaps hh, mm) that the stem has.

        One pattern holds all forms; the groups of those that didn't match are empty in the replacement.
        """
        names: dict[str, list[str]] = {}
        whole = "|".join(forms)
        for i, g in enumerate(re.findall(r"\(\?<([a-z]+)>", whole), 1):
            names.setdefault(g, []).append(f"${{g{i}}}")
        numbered = iter(range(1, 1000))
        whole = "(?i)^(?:" + re.sub(r"\(\?<[a-z]+>", lambda _: f"(?<g{next(numbered)}>", whole) + ").*$"
        return F.when(s.rlike(whole), F.regexp_replace(s, whole, slug + "_" + re.sub(r"<([a-z]+)>", lambda m: "".join(names[m[1]]), template)))

    y, m, d = r"(?<y>\d{4})", r"(?<m>\d{2})", r"(?<d>\d{2})"
    ymd, dashed, clock = y + m + d, f"{y}-{m}-{d}", r"(?<hh>\d{2})(?<mm>\d{2})"
    canonical = rf"^({slug}_\d{{4}}-\d{{2}}-\d{{2}}_\d{{2}}-\d{{2}}-\d{{2}})(\s+copy)?$"
    timed = [rf".*?App[_ ]Recording[_ ]+{ymd}[_ ]+{clock}", rf".*?Input Device Recording\s+{ymd}\s+{clock}"]
    dated = [rf".*?Podcast {spaced}\s+{ymd}", rf"{spaced}\s+{ymd}", rf"{spaced}\s*-\s*{dashed}"]
    if pipeline:
        dated += [rf"{spaced}\s+{dashed}(?:\s|$)", rf"{under}_-_{dashed}", rf"{under}-{dashed}", rf"{slug}\s+{dashed}", rf"(?-i:rec_)\({y}_{m}_{d}\)_"]
    else:
        dated += [rf"{under}_-_{dashed}", rf"(?-i:rec_){ymd}_\d{{4}}"]
    dated.append(rf"(?-i:rec_)\({m}_{d}_{y}\)_")
    rules = [F.when(s.rlike(canonical), F.regexp_extract(s, canonical, 1)), either(timed, "<y>-<m>-<d>_<hh>-<mm>-00"), either(dated, "<y>-<m>-<d>_07-30-00")]
    table = MONTH_DAYS_PIPELINE if pipeline else MONTH_DAYS_SCRIPTS
    days = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    for pattern in (rf"(?i)^(Jan|Feb|March|April)\s+(\d{{1,2}})\s*-\s*{spaced}", rf"(?i)^{spaced}\s+(Jan|Feb|March|April)\s+(\d{{1,2}})"):
        day = F.try_element_at(days, F.lower(F.concat(F.regexp_extract(s, pattern, 1), F.lit(" "), F.regexp_extract(s, pattern, 2))))
        rules.append(F.when(s.rlike(pattern) & day.isNotNull(), F.concat(F.lit(slug + "_"), day, F.lit("_07-30-00"))))
    found = F.coalesce(*rules)
    return F.when(F.lower(key).endswith(".mp3"), found) if pipeline else F.coalesce(found, s)
