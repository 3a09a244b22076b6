"""Dates, durations, labels, coordinates and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"


def id_date(c: Column) -> Column:
    """The first date in an id."""
    return F.nullif(F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")).try_cast("date")


def date_text(c: Column) -> Column:
    """YYYY-MM-DD, with as many digits as the year has; Spark's own text has a plus sign before years after 9999."""
    return _unsigned(c.cast("string"))


def _unsigned(c: Column) -> Column:
    return F.replace(c, F.lit("+"), F.lit(""))


def month(c: Column) -> Column:
    return _unsigned(F.date_format(c, "yyyy-MM"))


def month_day(c: Column) -> Column:
    return F.date_format(c, "MM-dd")


def wall_clock(ts: Column, zone: str = ZONE) -> Column:
    """h:mm AM of a UTC instant in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "h:mm a")


def today_month_day(zone: str = ZONE) -> Column:
    """MM-DD of now in a zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), F.localtimestamp()), "MM-dd")


def long_date(d: Column) -> Column:
    return _unsigned(F.date_format(d, "MMMM d, yyyy"))


def short_date(d: Column) -> Column:
    return _unsigned(F.date_format(d, "MMM d, yyyy"))


def thursdays(start: Column, end: Column) -> Column:
    """Every Thursday from start to end, both included; none if there is none."""
    first = F.next_day(F.date_sub(start, 1), "THU")
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 7 day"))).otherwise(F.array().cast("array<date>"))


def hours_minutes(ms: Column) -> Column:
    """`Xh Ym`, or `Ym` under an hour; '' for null and 0."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def clock(ms: Column) -> Column:
    """`h:mm:ss`, or `m:ss` under an hour."""
    s = F.floor(ms / 1000)
    h, m, x = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h, F.lit(":"), two(m), F.lit(":"), two(x))).otherwise(F.concat(m, F.lit(":"), two(x)))


def elapsed(seconds: Column) -> Column:
    """`Ns`, `x.x min` or `Xh Ym`."""
    h = F.floor(seconds / 3600)
    m = F.floor(seconds % 3600 / 60 + 0.5)
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds + 0.5), F.lit("s")))
        .when(seconds < 3600, F.concat(F.format_string("%.1f", F.round(seconds / 60, 1)), F.lit(" min")))
        .otherwise(F.concat(h, F.lit("h "), m, F.lit("m")))
    )


def guest_label(names: Column) -> Column:
    """a; a & b; a, b & c; a, b & n others; null for nobody."""
    n = F.size(names)
    at = lambda i: F.get(names, F.lit(i))
    return (
        F.when(n == 1, at(0))
        .when(n == 2, F.concat(at(0), F.lit(" & "), at(1)))
        .when(n == 3, F.concat(at(0), F.lit(", "), at(1), F.lit(" & "), at(2)))
        .when(n > 3, F.concat(at(0), F.lit(", "), at(1), F.lit(" & "), n - 2, F.lit(" others")))
    )


def places_label(names: Column) -> Column:
    """How many places are mentioned, with up to three examples; '' for none."""
    n = F.size(names)
    at = lambda i: F.get(names, F.lit(i))
    head = F.concat(n, F.when(n == 1, " place mentioned like ").otherwise(" places mentioned like "))
    return F.when(n == 0, "").when(n == 1, F.concat(head, at(0), F.lit("."))).when(n == 2, F.concat(head, at(0), F.lit(" and "), at(1), F.lit("."))).otherwise(F.concat(head, at(0), F.lit(", "), at(1), F.lit(", and "), at(2), F.lit(".")))


def megabytes(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(size / 1048576.0, 1)), F.lit(" MB"))


def js_round(c: Column) -> Column:
    """Half toward positive infinity."""
    return F.floor(c + 0.5)


def page_number(c: Column) -> Column:
    """At least 1; what isn't a number counts as 1."""
    return F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int"), F.lit(1)))


def byte_range(c: Column) -> Column:
    """first and last (null: to the end) of `bytes=a-b`; null if it isn't one."""
    first = F.nullif(F.regexp_extract(c, r"bytes=(\d+)-(\d*)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(c, r"bytes=(\d+)-(\d*)", 2), F.lit(""))
    return F.when(first.isNotNull(), F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))


def audio_key(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]+\.m4a$")


def in_box(lat: Column, lng: Column, south: float = 37.7, north: float = 37.84, west: float = -122.52, east: float = -122.35) -> Column:
    """Inside the city's bounds (fixed defaults)."""
    return lat.between(south, north) & lng.between(west, east)


def circle_radius(count: Column, largest: Column) -> Column:
    return 6 + 22 * F.sqrt(count / largest)


def star_scale(count: Column, largest: Column) -> Column:
    """ln count / ln largest; size is 1 + 11 t and opacity 0.15 + 0.85 t."""
    return F.when(largest > 1, F.ln(count) / F.ln(largest)).otherwise(1.0)


def sky_xyz(azimuth: Column, altitude: Column) -> Column:
    """Unit vector of a direction in degrees: x east, y up, z north."""
    a, h = F.radians(azimuth), F.radians(altitude)
    return F.struct((F.cos(h) * F.sin(a)).alias("x"), F.sin(h).alias("y"), (F.cos(h) * F.cos(a)).alias("z"))


def compass_point(azimuth: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, (F.floor(F.pmod(azimuth, F.lit(360.0)) / 45 + 0.5) % 8).cast("int"))


def fnv1a(word: Column, tail: bytes = b"") -> Column:
    """32-bit FNV-1a of a word's characters and tail."""
    codes = F.transform(F.filter(F.split(word, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    if tail:
        codes = F.concat(codes, F.array(*[F.lit(b).cast("long") for b in tail]))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 0x01000193).bitwiseAND(0xFFFFFFFF))


def right_ascension(word: Column) -> Column:
    return js_round((fnv1a(word) % 864000) / 36000 * 1000) / 1000


def declination(word: Column) -> Column:
    return js_round(((fnv1a(word, b"\x00") % 18001) / 100 - 90) * 100) / 100
