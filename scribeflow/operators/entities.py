"""Candidate places and guests: merging, matching against segments, similar names, clean-up and seeding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scribeflow.functions import names as N
from scribeflow.functions import text as T
from scribeflow.operators import trie, windows
from scribeflow.operators.keyed import KeyedTable
from scribeflow.runtime import tasks_for, written


def candidate_union(*sources: DataFrame) -> DataFrame:
    """All candidates of all sources; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each normalised name: scalars of the first row (by ord), sources and categories in order of
    appearance, and the first row's coordinates, or, if one of them is null, the first complete pair."""
    rows = candidates.withColumn("normalized_name", N.normalize_name(F.col("name")))
    ordered = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda r: r[c]), lambda v: F.coalesce(v, F.lit("")) != ""))
    both = F.struct("lat", "lng")
    whole = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    out = rows.groupBy("normalized_name").agg(
        F.min_by(F.struct("name", "source", "category"), "ord").alias("_f"),
        ordered("source").alias("sources"),
        ordered("category").alias("categories"),
        F.min_by(both, "ord").alias("_own"),
        F.min_by(both, F.when(whole, F.col("ord"))).alias("_whole"),
        F.count_if(whole).alias("_k"),
    )
    use = F.when(F.col("_own.lat").isNotNull() & F.col("_own.lng").isNotNull() | (F.col("_k") == 0), F.col("_own")).otherwise(F.col("_whole"))
    return out.withColumn("_c", use).select("normalized_name", "_f.name", "_f.source", "sources", "_f.category", "categories", "_c.lat", "_c.lng")


def usable_candidates(merged: DataFrame, stoplist: tuple[str, ...] = N.PLACE_STOPLIST) -> DataFrame:
    return merged.where(~N.unusable_name(F.col("name"), stoplist))


def _pieces(c: Column, size: int) -> Column:
    """The distinct runs of size characters of a text of at least so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size))))


def longer_names_only(names: DataFrame, column: str = "normalized_name") -> DataFrame:
    """names without those that stand inside a longer one.

    A name looks for longer ones by its rarest three letters (a shorter name
    by all of it), so a beginning that very many names share is no meeting
    place; what meets is verified.
    """
    n = F.col(column)
    own = names.select(n.alias("_a")).distinct()
    threes = own.where(F.length("_a") >= 3).select("_a", F.explode(_pieces(F.col("_a"), 3)).alias("_p"))
    rarest = threes.join(threes.groupBy("_p").agg(F.count("*").alias("_n")), "_p").groupBy("_a").agg(F.min_by("_p", F.struct("_n", "_p")).alias("_p"))
    short = own.where(F.length("_a").between(1, 2)).select("_a", F.col("_a").alias("_p"))
    probes = threes.select(F.col("_a").alias("_b"), "_p")
    for size in (1, 2):
        probes = probes.unionByName(own.where(F.length("_a") > size).select(F.col("_a").alias("_b"), F.explode(_pieces(F.col("_a"), size)).alias("_p")))
    inside = rarest.unionByName(short).join(probes, "_p").where(F.col("_b").contains(F.col("_a")) & (F.col("_a") != F.col("_b"))).select(F.col("_a").alias(column)).distinct()
    return names.join(inside, column, "left_anti").select(names.columns)


def grouped_guests(links: DataFrame, name: str = "guest_name") -> DataFrame:
    """guest_name (the smallest spelling), n: guests whatever their case."""
    return links.groupBy(F.lower(name).alias("_k")).agg(F.min(name).alias("guest_name"), F.count("*").alias("n")).drop("_k")


#: Names that share a run from which on it is no meeting place; shortened forms of a name, at most, that take its place.
HOT, FORMS = 1000, 3000
#: Pairs that a task compares, about.
PAIRS = 2_000_000
#: Names that a task shortens, about.
NAMES = 20_000


def _edits(n: Column, percent: int) -> Column:
    """Edits at most between a name of n letters and its longest possible partner."""
    return F.floor(F.floor(n * 100 / percent) * (100 - percent) / 100).cast("int")


def _shortened(names: DataFrame) -> DataFrame:
    """k, n, form of names (k, n, most): each name with up to most letters left out, in every way."""
    kind = StructType.fromDDL("k string, n int, form string")
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                forms = {"".join(left) for gone in range(most + 1) for left in combinations(k, len(k) - gone)}
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(forms)), pa.array([n] * len(forms), pa.int32()), pa.array(list(forms))], schema=out)

    return names.select("k", "n", "most").mapInArrow(run, kind)


def similar_names(names: DataFrame, column: str = "guest_name", percent: int = 85, hot: int = HOT) -> DataFrame:
    """a, b, sim: pairs of distinct names (a before b) whose similarity is percent / 100 or more (percent: 75 or more).

    Names within e edits share all but e * q of their runs of q letters, so at
    least one of the e * q + 1 rarest of each. Pairs come from equal rare runs,
    of lengths that fit, and are verified: no product of all names. A run that
    more than hot names share is no meeting place: names that have one among their rarest meet
    by what is left of both after e letters are left out, so what is compared
    there is within 2 * e edits, however many names share their runs. Names of which that would
    make more than FORMS forms (from about 27 letters on) still meet by such runs.
    """
    if percent < 75:
        raise ValueError("similar names are found from 75 % on")
    q = 3 if percent >= 84 else 2
    own = names.select(F.trim(F.lower(column)).alias("k"), F.col(column).alias("name")).where(F.length("k") > 0)
    keys = own.select("k").distinct().withColumn("n", F.length("k")).withColumn("edits", _edits(F.col("n"), percent)).where(F.col("n") >= q)
    keys = keys.withColumn("most", F.col("edits") * q + 1)
    runs = keys.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - (q - 1)))).withColumn("run", F.substring("k", F.col("i"), F.lit(q)))
    again = F.row_number().over(W.partitionBy("k", "run").orderBy("i"))  # repeats of a run in a name are runs of their own
    runs = runs.withColumn("run", F.concat("run", again.cast("string"))).select("k", "n", "edits", "most", "run")
    counts = runs.groupBy("run").agg(F.count("*").alias("times"))
    place = F.row_number().over(W.partitionBy("k").orderBy("times", "run"))
    rare = runs.join(counts, "run").withColumn("place", place).where(F.col("place") <= F.col("most")).select("k", "n", "edits", "run", "times")
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent

    def meeting(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
        # few bytes make very many pairs: tasks follow the pairs, as adaptive execution would put all in one
        n, m = (side.groupBy(at).agg(F.count("*").alias(c)) for side, c in ((left, "_l"), (right, "_r")))
        made = n.join(m, at).agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
        tasks = tasks_for(names.sparkSession, made, PAIRS)
        left, right = left.repartition(tasks, at), right.repartition(tasks, at)
        x, y = left.select(F.col("k").alias("x"), F.col("n").alias("nx"), at), right.select(F.col("k").alias("y"), F.col("n").alias("ny"), at)
        return x.join(y, at).where((F.col("x") != F.col("y")) & fits).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    pairs = meeting(rare.where(F.col("times") <= hot), rare.where(F.col("times") <= hot), "run")
    if not counts.where(F.col("times") > hot).isEmpty():
        crowded = rare.where(F.col("times") > hot)
        forms = F.lit(1).cast("double")  # n over edits
        for i in range(8):
            forms = forms * F.when(F.col("edits") > i, (F.col("n") - i) / (i + 1)).otherwise(1)
        many = (forms > FORMS) | (F.col("edits") > 8)
        crowd = crowded.where(~many).select("k", "n", F.col("edits").alias("most")).distinct()
        short = written(_shortened(crowd.repartition(tasks_for(names.sparkSession, crowd.count(), NAMES), "k")), "forms")
        pairs = pairs.unionByName(meeting(short, short, "form")).unionByName(meeting(crowded, crowded.where(many), "run"))
    pairs = pairs.distinct().withColumn("sim", T.similarity(F.col("x"), F.col("y"))).where(F.col("sim") * 100 >= percent - 1e-9)
    spelt = lambda k, c: own.select(F.col("k").alias(k), F.col("name").alias(c))
    close = pairs.join(spelt("x", "p"), "x").join(spelt("y", "r"), "y").select("p", "r", "sim")
    same = spelt("x", "p").join(spelt("x", "r"), "x").where("p < r").select("p", "r", F.lit(1.0).alias("sim"))  # spellings of one name
    return close.unionByName(same).select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b"), "sim").distinct()


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")


def mentions(candidates: DataFrame, segments: DataFrame, name: str = "name", block: int = trie.BLOCK) -> DataFrame:
    """Each candidate with each segment that holds its name as whole words, whatever the case.

    The names' words are looked for in each segment where it is read (see trie);
    what has them in a row is verified with all that stands between. A name
    without an ASCII word, which only matches between word characters, is
    looked for by its first character where one stands behind a word character.
    """
    found = _named(candidates, segments, name, block)
    return candidates.join(found, F.col(name) == F.col("_name")).drop("_name")


def _named(candidates: DataFrame, segments: DataFrame, name: str, block: int = trie.BLOCK) -> DataFrame:
    """The segments with each name (_name) that they hold, made where the text is read: nothing is shuffled."""
    left = candidates.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct().withColumn("_t", _words(F.col("_name")))
    rows = trie.found(left, segments.withColumn("_t", _words(F.col("text"))), block)
    bare = left.where(F.size("_t") == 0).select("_name", F.lower(F.substring("_name", 1, 1)).alias("_w"))
    behind = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?<=\w)(\W)")), F.lower))
    if not bare.isEmpty():
        rows = rows.unionByName(segments.withColumn("_w", F.explode(behind)).join(bare, "_w").select(*segments.columns, "_name"))
    return rows.where(T.whole_word(F.col("text"), F.col("_name")))


def phrase_mentions(names: DataFrame, texts: DataFrame, name: str = "normalized_name", block: int = trie.BLOCK) -> DataFrame:
    """Each name with each text (window or segment) whose search tokens hold those of the name in a row."""
    hits = _phrase_hits(names, texts, name, block)
    return names.join(hits, F.col(name) == F.col("_name")).drop("_name")


def _phrase_hits(names: DataFrame, texts: DataFrame, name: str, block: int = trie.BLOCK, keep: list[str] | None = None) -> DataFrame:
    """_name and the columns keep (all) of the texts that hold it; what isn't kept isn't copied for each hit."""
    left = names.select(F.col(name).alias("_name")).distinct().withColumn("_t", T.search_tokens(T.phrase_query(F.col("_name"))))
    return trie.found(left, texts.select(*(keep or texts.columns), T.search_tokens(F.col("text")).alias("_t")), block)


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counted names, most mentioned first, then by name in the order of a reader's alphabet."""
    return counts.orderBy(F.desc("total_mentions"), *[F.collate(F.col(k), "UNICODE") for k in keys], *keys)


def match_counts(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, episode_count, total_mentions."""
    return matched.groupBy(keys).agg(F.countDistinct("episode_id").alias("episode_count"), F.count("*").alias("total_mentions"))


def mention_counts(candidates: DataFrame, segments: DataFrame, name: str = "name") -> DataFrame:
    """match_counts of mentions by name: hits are counted where the texts are read, before names meet, so a name found everywhere is no large group."""
    counts = match_counts(_named(candidates, segments.select("episode_id", "text"), name), ["_name"])
    times = candidates.groupBy(F.col(name).alias("_k")).agg(F.count("*").alias("_times"))
    return counts.join(times, F.col("_name") == F.col("_k")).select(F.col("_name").alias(name), "episode_count", (F.col("total_mentions") * F.col("_times")).alias("total_mentions"))


def match_records(matched: DataFrame, keys: list[str], cut: int = 200) -> DataFrame:
    """keys, episode_id, episode_count, total_mentions, mentions (start_ms, end_ms, context, in order): a row an episode,
    most mentioned first, so that a name found everywhere is no row without bounds."""
    per = matched.groupBy(*keys, "episode_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", F.substring("text", 1, cut).alias("context")))).alias("mentions"))
    counts = match_counts(matched, keys)
    return per.join(counts, keys).select(*keys, "episode_id", "episode_count", "total_mentions", "mentions").orderBy(F.desc("total_mentions"), *keys, "episode_id")


def first_context(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, context: the text of the first mention in the first episode."""
    return matched.groupBy(keys).agg(F.min_by("text", F.struct("episode_id", "start_ms")).alias("context"))


def business_candidates(registry: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """normalized_name, start_ms, end_ms (least and greatest), address (of the earliest), reason why it isn't searched."""
    per = registry.groupBy("normalized_name").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("address", F.struct("start_ms", "address")).alias("address"))
    return per.withColumn("reason", N.skip_reason(F.col("normalized_name"), F.array(*map(F.lit, blocked))))


def verified(records: DataFrame, verify: Callable[[DataFrame], DataFrame] | None, keys: list[str], on_error: str = "reject") -> DataFrame:
    """records with confidence by an external check: llm_verified, or left out; without one, unverified.

    verify: from keys and context to keys and verdict (boolean; null where a batch failed: kept or left out by on_error).
    """
    if verify is None:
        return records.withColumn("confidence", F.lit("unverified"))
    verdict = verify(records.select(*keys, "context"))
    good = F.coalesce(F.col("verdict"), F.lit(on_error == "keep"))
    return records.join(verdict, keys).where(good).withColumn("confidence", F.when(F.col("verdict").isNull(), "unverified").otherwise("llm_verified")).drop("verdict")


def place_review(places: DataFrame, links: DataFrame, stoplist: tuple[str, ...] = N.PLACE_STOPLIST, known: tuple[str, ...] = N.KNOWN_PLACES) -> DataFrame:
    """id, name, ep_count, decision (remove_short, remove_stoplist, known, verify) of each place."""
    counts = links.groupBy("place_id").agg(F.count("episode_id").alias("ep_count"))
    rows = places.join(counts, places["id"] == counts["place_id"], "left").withColumn("ep_count", F.coalesce("ep_count", F.lit(0)))
    low = F.lower("name")
    rule = F.when(F.length("name") <= 2, "remove_short").when(low.isin(*stoplist), "remove_stoplist").when(low.isin(*known), "known").otherwise("verify")
    return rows.select("id", "name", "ep_count", rule.alias("decision"))


def place_samples(places: DataFrame, segments: DataFrame) -> DataFrame:
    """places with the first segment (by episode and order) that names them, or null."""
    own = segments.select("episode_id", "seq", "text")
    # hits are narrowed to ids where the texts are read; texts are fetched for the first ones alone
    first = written(_named(places, own.select("episode_id", "text"), "name").groupBy("_name").agg(F.min("episode_id").alias("episode_id")), "first")
    again = own.join(first.select("episode_id").distinct(), "episode_id", "left_semi")
    seq = _named(first.select("_name"), again, "_name").select("_name", "episode_id", "seq").join(first, ["_name", "episode_id"]).groupBy("_name", "episode_id").agg(F.min("seq").alias("seq"))
    texts = own.join(written(seq, "place"), ["episode_id", "seq"]).where(T.whole_word(F.col("text"), F.col("_name")))
    found = texts.groupBy(F.col("_name").alias("name")).agg(F.min("text").alias("context"))
    return places.join(found, "name", "left").select(*places.columns, "context")


#: Where a place goes whose address isn't found: the city's centre. Fixed values.
CITY_CENTRE = (37.7749, -122.4194)


def located(plan: DataFrame, found: DataFrame, fallback: tuple[float, float] | None = CITY_CENTRE) -> DataFrame:
    """Rows to insert: those of a plan with coordinates, and those to geocode with what a lookup found (name, lat, lng).

    Where it found nothing, the fallback's coordinates count; without a fallback such rows are left out.
    """
    hits = found.groupBy("name").agg(F.min(F.struct("lat", "lng")).alias("_c"))
    rows = plan.where(F.col("plan").isin("insert", "geocode")).join(hits, "name", "left")
    own = F.col("plan") == "insert"
    value = lambda c, i: F.when(own, F.col(c)).otherwise(F.coalesce(F.col(f"_c.{c}"), F.lit(fallback[i] if fallback else None).cast("double"))).alias(c)
    keep = [c for c in plan.columns if c not in ("lat", "lng")]
    return rows.select(*keep, value("lat", 0), value("lng", 1)).where("lat IS NOT NULL AND lng IS NOT NULL")


def pending_corrections(links: DataFrame, renames: DataFrame, deletes: DataFrame, name: str = "guest_name") -> DataFrame:
    """old, new (null: deleted), episodes, merges (whether the new name has links already) of corrections that links still need."""
    counts = links.groupBy(F.col(name).alias("old")).agg(F.count("*").alias("episodes"))
    asked = renames.select("old", "new").unionByName(deletes.select("old", F.lit(None).cast("string").alias("new")))
    there = links.select(F.col(name).alias("new"), F.lit(True).alias("merges")).distinct()
    return asked.join(counts, "old").join(there, "new", "left").select("old", "new", "episodes", F.coalesce("merges", F.lit(False)).alias("merges"))


def seeding_plan(matches: DataFrame, places: DataFrame, stoplist: tuple[str, ...]) -> DataFrame:
    """matches (name, lat, lng, address, ...) not on the stop-list, with place_id and plan (link, insert, geocode, skip)."""
    known = places.groupBy(F.lower("name").alias("_n")).agg(F.max("id").alias("place_id"))
    rows = matches.where(~F.lower("name").isin(*stoplist)).join(known, F.lower("name") == F.col("_n"), "left").drop("_n")
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return rows.withColumn("plan", F.when(F.col("place_id").isNotNull(), "link").when(placed, "insert").when(~T.missing(F.col("address")), "geocode").otherwise("skip"))


def links_by_name(matches: DataFrame, places: DataFrame) -> DataFrame:
    """place_id, episode_id for each match (name, episodes: array) whose name a place has, whatever the case."""
    known = places.groupBy(F.lower("name").alias("_n")).agg(F.max("id").alias("place_id"))
    return matches.join(known, F.lower("name") == F.col("_n")).select("place_id", F.explode("episodes").alias("episode_id")).distinct()


def geocode_steps(city: str) -> list[tuple[Column | None, bool]]:
    """The query of each step for a name (null: it has none), and whether it is bounded to the city."""
    two = T.intersection(F.col("name"))
    whole = F.concat("name", F.lit(f" {city} CA"))
    return [(whole, True), (F.concat(two[0], F.lit(" and "), two[1], F.lit(f", {city}")), True), (F.concat(two[0], F.lit(f", {city} CA")), True), (whole, False)]


def geocode_cascade(names: DataFrame, lookup: Callable[[DataFrame], DataFrame], city: str = "San Francisco", cache: KeyedTable | None = None) -> DataFrame:
    """names with lat, lng by the first query that finds something: the place, the crossing, its first street, anywhere.

    Each step asks only for names that are still open, once for each distinct query. lookup: from name, step,
    query, bounded to name, step, lat, lng (rows only for hits); of several hits the smallest counts. Hits of the
    unbounded last step count inside the city's bounds alone. A cache (a table with keys query, bounded and the columns
    lat, lng: null for what isn't found) answers what it knows, and takes what is asked.
    """
    from scribeflow.functions import formats as X

    own = written(names.select("name").where("name IS NOT NULL").distinct(), "open")
    still, hits = own, []
    for step, (query, bounded) in enumerate(geocode_steps(city), 1):
        asked = still.select("name", query.alias("query")).where("query IS NOT NULL")
        asked = asked.select("name", F.lit(step).alias("step"), "query", F.lit(bounded).alias("bounded"))
        known = None
        if cache is not None:
            known = written(asked.join(cache.rows(), ["query", "bounded"]), "known")
            asked = asked.join(known, ["query", "bounded"], "left_anti")
        asked = written(asked.select("name", "step", "query", "bounded"), "asked")
        if not asked.isEmpty():
            each = asked.groupBy("step", "query", "bounded").agg(F.min("name").alias("name")).select("name", "step", "query", "bounded")
            found = lookup(each).groupBy("name").agg(F.min(F.struct("lat", "lng")).alias("c")).select("name", "c.lat", "c.lng")
            found = written(each.join(found, "name", "left").select("query", "bounded", "lat", "lng"), "found")
            if cache is not None:
                cache.upsert(found)
            answers = asked.join(found, ["query", "bounded"])
            known = answers if known is None else answers.unionByName(known, allowMissingColumns=True)
        if known is not None:
            good = known.where("lat IS NOT NULL AND lng IS NOT NULL")
            hits.append(written((good if bounded else good.where(X.in_box(F.col("lat"), F.col("lng")))).select("name", "lat", "lng"), "hits"))
            still = still.join(hits[-1], "name", "left_anti")
    best = hits[0] if hits else own.select("name", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")).limit(0)
    for h in hits[1:]:
        best = best.unionByName(h)
    best = best.withColumnsRenamed({"lat": "_lat", "lng": "_lng"})
    return names.join(best, "name", "left").select(*names.columns, F.col("_lat").alias("lat"), F.col("_lng").alias("lng"))


def first_per_name(candidates: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return candidates.withColumn("_r", rank).where("_r = 1").drop("_r")


def places_by_episode(extracted: DataFrame) -> DataFrame:
    """name (trimmed), episodes (sorted set) of replies (episode_id, raw_response: a JSON array)."""
    rows = extracted.select("episode_id", F.explode(T.json_names("raw_response")).alias("name")).withColumn("name", F.trim("name")).where("name <> ''")
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("episode_id")).alias("episodes"))


def cross_reference(names: DataFrame, segments: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """normalized_name, episode_count, total_mentions, confidence of names against windows of six segments."""
    ask = business_candidates(names, blocked).where("reason IS NULL")
    hits = _phrase_hits(ask, windows.count_windows(segments), "normalized_name", keep=["episode_id"])
    out = match_counts(hits.withColumnRenamed("_name", "normalized_name"), ["normalized_name"])  # ask has a name once
    return out.withColumn("confidence", N.confidence(F.col("normalized_name"), F.col("episode_count"))).where("confidence <> 'skip'")
