"""Text predicates, clean-up, tokens and parsers."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mishearings of the host's name, and what was said. Fixed values.
HOST_MISHEARD = r"(?i)(?<!\w)(nearly|yearly|really|eerily|dearly)\s+(bird|beard)(?!\w)"
HOST_NAME = "Early Bird"


def java_quoted(literal: str) -> str:
    """A literal for use inside a Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", literal)


def missing(c: Column) -> Column:
    """Null or ''."""
    return F.coalesce(c, F.lit("")) == ""


def falsy_or(a: Column, b: Column) -> Column:
    """a unless it is null or '', else b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def correct_words(c: Column, corrections: dict[str, str]) -> Column:
    """Whole words replaced, whatever their case."""
    return reduce(lambda x, kv: F.regexp_replace(x, rf"(?i)(?<!\w){java_quoted(kv[0])}(?!\w)", kv[1].replace("\\", "\\\\").replace("$", "\\$")), corrections.items(), c)


def fix_host(c: Column) -> Column:
    return F.regexp_replace(c, HOST_MISHEARD, HOST_NAME)


def word_count(c: Column) -> Column:
    """Words of the trimmed text; '' counts as one, as a split does."""
    return F.size(F.split(js_trim(c), r"\s+"))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_internal_loop(c: Column) -> Column:
    """Twelve words or more, of which some phrase of three to eight comes four times in a row."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"\s+", " "), F.lit(" "))
    words = F.split(F.lower(c), r"\s+")
    few = F.size(F.array_distinct(words)) <= F.size(words) - 9  # a run of three words or more that stands four times repeats nine
    return (F.size(words) >= 12) & few & flat.rlike(r" ((?:\S+ ){2,7}\S+ )\1{3}")


def search_phrases(query: str) -> list[str]:
    """The phrases of a search box: special characters part terms, and all terms must match. Empty: no query."""
    return re.sub(r'["*(){}\[\]:^~]', " ", query).split()


def phrase_query(c: Column) -> Column:
    """A name as one phrase without special characters; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"""['"*(){}\[\]:^~!@#$%&]""", "")), F.lit(""))


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks and their bare letters, by canonical decomposition."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != chr(cp):
            pairs[chr(cp)] = bare
    return "".join(pairs), "".join(pairs.values())


def strip_accents(c: Column) -> Column:
    """Letters without their marks. ASCII texts, which have none, are spared the character-by-character look-up."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, *_accents()))


def padded_tokens(c: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits in order, each between blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


#: A token in lower-cased, accent-folded text.
_TOKEN = r"[\p{L}\p{N}]+"


def search_tokens(c: Column) -> Column:
    """The same as an array."""
    return F.regexp_extract_all(F.lower(strip_accents(c)), F.lit(_TOKEN), F.lit(0))


def count_tokens(c: Column) -> Column:
    """How many search_tokens there are."""
    return F.regexp_count(F.lower(strip_accents(c)), F.lit(_TOKEN))


def tokens_of(phrase: str) -> list[str]:
    """search_tokens for a query on the driver."""
    bare = "".join(x for x in unicodedata.normalize("NFD", phrase) if not unicodedata.combining(x))
    return [t for t in re.split(r"[\W_]+", bare.lower()) if t]


def whole_word(text: Column, name: Column) -> Column:
    """name stands in text between ASCII word borders, whatever the case; name is taken literally."""
    quoted = F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    left = F.when(name.rlike(r"^\w"), r"(?iu)(?<!\w)").otherwise(r"(?iu)(?<=\w)")
    right = F.when(name.rlike(r"\w$"), r"(?!\w)").otherwise(r"(?=\w)")
    return F.regexp_like(text, F.concat(left, quoted, right))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of trimmed lower-cased names; two empty names are equal."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def json_names(c: Column) -> Column:
    """The strings of a JSON array inside an optional code fence; anything else: no strings."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?\s*|```", ""))
    return F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>"))


def summary_reply(c: Column) -> Column:
    """title, summary, guests of a JSON reply; a reply that isn't JSON is itself the summary."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?\s*|```", ""))
    row = F.from_json(bare, "title string, summary string, guests string", {"mode": "PERMISSIVE"})
    good = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    guests = F.coalesce(F.from_json(row["guests"], "array<string>"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(good, row["title"]).alias("title"),
        F.when(good, F.coalesce(row["summary"], c)).otherwise(c).alias("summary"),
        F.when(good, guests).otherwise(none).alias("guests"),
    )


def verdicts(reply: Column, size: Column, yes: str = "YES", no: str = "NO", default: str = "NO") -> Column:
    """Verdicts 1 to size of a reply of lines `N. YES - reason`; absent ones default, the last of several counts."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.regexp_extract(F.upper(F.trim(x)), rf"^(\d+)\.\s*({yes}|{no})", 0)), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.regexp_extract(x, rf"({yes}|{no})$", 1).alias("v")))
    last = lambda i: F.element_at(F.filter(pairs, lambda p: p["n"] == i), -1)["v"]
    has = lambda i: F.exists(pairs, lambda p: p["n"] == i)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(has(i), last(i)).otherwise(F.lit(default)))


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def percent_encoded(c: Column) -> Column:
    """url_encode, with %20 for blanks."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def join_parts(*parts: Column) -> Column:
    """The parts that aren't null or '', joined by ', '."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def intersection(c: Column) -> Column:
    """The two streets of `A & B` or `A and B`; null unless there are just two."""
    parts = F.transform(F.split(c, r"(?i)\s*[&]\s*|\s+and\s+"), lambda x: F.trim(x))
    return F.when((c.contains("&") | c.contains(" and ")) & (F.size(parts) == 2), parts)


def page_date(html: Column) -> Column:
    """The date of a broadcast page: its metadata, else a content stamp, else a time element."""
    one = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.coalesce(one(r'datePublished["\s:]+(\d{4}-\d{2}-\d{2})'), one(r'content="(\d{4}-\d{2}-\d{2})T'), one(r'<time[^>]+datetime="(\d{4}-\d{2}-\d{2})"'))


def audio_source(html: Column) -> Column:
    """The decoded audio address of a broadcast page, or null."""
    return F.try_to_binary(F.nullif(F.regexp_extract(html, r'data-audio-src="([^"]+)"', 1), F.lit("")), F.lit("base64")).cast("string")
