"""A stored text index that takes inserts, updates and deletes: immutable segments, tombstones, and merges by size.

Every batch is one generation. It writes a segment with the postings of its
episodes, and a tombstone (episode, generation) for every episode that it
writes or deletes and that an older segment has, so its cost follows its own
rows (of older segments it reads ids alone). A row of a segment counts
if no tombstone of its episode has a later generation than the segment.

A merge takes the newest segments, up to the oldest that is no larger than all
after it together, and writes what counts of them as one segment of the newest
generation. Then each segment is larger than all newer ones together, so there
are no more than a logarithm of the rows, and a row is rewritten no more often.
Tombstones older than every segment go.

For pages of newest episodes a segment also has a table of how many segments
hold each term, and the list has the ids from which on it has 64, 128, ...
episodes; while no tombstone is left, ranks come from those, and only the newest
postings are read.

Segments and tombstones are Parquet; a segment lies in ranges of term and
episode, so a query reads the row groups of its terms. A batch's texts are
tokenised once: lengths come from rows without a term that are written beside its
postings. Versions are put in place
in one step (see snapshots): a batch that fails leaves the version before, and
readers keep theirs.

Defined cases: rows without an episode id aren't kept; of a batch with an
episode both written and deleted the new rows stay; a delete of an unknown
episode changes no result; an empty batch commits no version; episodes without
tokens count in lengths with their segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.operators import textindex
from scribeflow.operators.snapshots import Snapshots
from scribeflow.runtime import tasks_for

#: Bytes of a row group, of which a query reads those of its terms and episodes.
GROUP = 16 << 20
#: How many newest episodes the bounds of a segment take in.
RANKS = (64, 128, 256, 512, 1024, 2048, 4096)
#: Of the files' layout: to be part of the name of an index that later code may meet.
LAYOUT = 2


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Snapshots(spark, folder)

    def _path(self, name: str, kind: str) -> str:
        return f"{self.log.folder}/data/{name}/{kind}"

    def _all(self, listed: list[dict], kind: str, ids: DataFrame) -> DataFrame:
        """Rows of kind in the listed parts with their generation (_gen); ids: an episode_id column, for its type."""
        schema = _schema(kind, ids)
        own = "term IS NOT NULL" if kind == "postings" else "true"
        parts = [self.spark.read.schema(schema).parquet(self._path(p["name"], kind)).where(own).withColumn("_gen", F.lit(p["gen"])) for p in listed]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{schema}, _gen int")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _type(self, listed: dict) -> DataFrame:
        return self.spark.createDataFrame([], f"episode_id {listed.get('id_type', 'bigint')}")

    def _alive(self, rows: DataFrame, listed: dict, among: list[dict]) -> DataFrame:
        """rows (with _gen) of the segments among that no tombstone of a later generation hits."""
        oldest = min((p["gen"] for p in among), default=0)
        dead = [p for p in listed.get("dead", []) if p["gen"] > oldest]
        if not dead:
            return rows.drop("_gen")
        last = self._all(dead, "dead", self._type(listed)).groupBy("episode_id").agg(F.max("_gen").alias("_last"))
        last = last.withColumnRenamed("episode_id", "_dead")
        return rows.join(last, (F.col("episode_id") == F.col("_dead")) & (F.col("_gen") < F.col("_last")), "left_anti").drop("_gen")

    def index(self, version: int | None = None) -> textindex.Index:
        """The index as of the newest version, or of another that is kept."""
        _, listed = self.log.read(version)
        parts = listed.get("segments", [])
        own = {kind: self._alive(self._all(parts, kind, self._type(listed)), listed, parts) for kind in ("postings", "lengths")}
        return textindex.Index(own["postings"], own["lengths"], self._newest(listed))

    def sound(self) -> bool:
        """Whether there is a version and all that it lists is there, as far as finished writes tell."""
        number, listed = self.log.read()
        parts = [(p["name"], k) for p in listed.get("segments", []) for k in ("postings", "lengths", "terms")] + [(p["name"], "dead") for p in listed.get("dead", [])]
        return bool(number) and all(self.log.has(f"data/{name}/{kind}/_SUCCESS") for name, kind in parts)

    def _newest(self, listed: dict) -> textindex.Newest | None:
        parts = listed.get("segments", [])
        if not parts or listed.get("dead"):  # counts hold rows that are dead
            return None
        terms = self._all(parts, "terms", self._type(listed)).groupBy("term").agg(F.sum("n").alias("n"))
        # the newest bound of any segment takes in at least as many episodes as that segment has from there on
        bounds = [max(p["bounds"][i] for p in parts if len(p["bounds"]) > i) for i in range(max(len(p["bounds"]) for p in parts))]
        return textindex.Newest(bounds, terms, sum(p["segments"] for p in parts), sum(p["tokens"] for p in parts))

    def _postings(self, rows: DataFrame) -> str:
        """Writes postings, that lie in ranges of term and episode; the name of their segment."""
        name = self.log.fresh()
        rows.sortWithinPartitions("term", "episode_id", "seq").write.option("parquet.block.size", GROUP).parquet(self._path(name, "postings"))
        return name

    def _segment(self, name: str, lengths: DataFrame, gen: int) -> dict | None:
        """Writes the rest of a segment whose postings are there; None if it has no rows."""
        lengths.sortWithinPartitions("episode_id").write.parquet(self._path(name, "lengths"))
        total = self.spark.read.parquet(self._path(name, "lengths")).agg(F.count("*").alias("episodes"), F.sum("segments").alias("segments"), F.sum("tokens").alias("tokens")).first()
        if not total["episodes"]:
            return None
        counts = self.spark.read.parquet(self._path(name, "postings")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
        counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(self._path(name, "terms"))
        top = self.spark.read.parquet(self._path(name, "lengths")).select("episode_id").orderBy(F.desc("episode_id")).limit(RANKS[-1]).collect()  # of bounded number
        bounds = [top[r - 1][0] for r in RANKS if r <= len(top)]
        return {"name": name, "gen": gen, "episodes": total["episodes"], "segments": total["segments"], "tokens": int(total["tokens"] or 0), "bounds": bounds}

    def write(self, segments: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """One batch: the episodes in segments (episode_id, seq, text) take the place of their older rows; those in deleted (episode_id) go.

        Returns the version. Writes only what it is given.
        """
        number, listed = self.log.read()
        gen = number + 1
        ids, new = [], None
        if segments is not None:
            rows = segments.where("episode_id IS NOT NULL").select("episode_id", "seq", "text")
            tasks, bounds = textindex.planned(rows)
            name = self._postings(textindex.to_store(rows, tasks, bounds).repartitionById(tasks, F.col("_range")).drop("_range"))
            totals = self.spark.read.schema(_schema("postings", rows)).parquet(self._path(name, "postings")).where("term IS NULL")
            new = self._segment(name, totals.groupBy("episode_id").agg(F.sum("seq").alias("segments"), F.sum("dl").alias("tokens")), gen)
        if new:
            ids.append(self.spark.read.parquet(self._path(new["name"], "lengths")).select("episode_id"))
        if deleted is not None:
            ids.append(deleted.where("episode_id IS NOT NULL").select("episode_id"))
        if not ids:
            return number
        kind = listed.get("id_type") or ids[0].schema["episode_id"].dataType.simpleString()
        gone = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1].select(F.col("episode_id").cast(kind)))
        old, dead = listed.get("segments", []), listed.get("dead", [])
        count = 0
        if old:  # only what an older segment has needs a tombstone
            there = self._all(old, "lengths", self._type(listed)).select("episode_id")
            name = self.log.fresh()
            gone.distinct().join(there, "episode_id", "left_semi").write.parquet(self._path(name, "dead"))
            count = self.spark.read.parquet(self._path(name, "dead")).count()
        if not new and not count:
            return number
        dead = dead + ([{"name": name, "gen": gen, "episodes": count}] if count else [])
        return self.log.commit(number, {"id_type": kind, "segments": old + ([new] if new else []), "dead": dead})

    def compact(self, whole: bool = False) -> int:
        """Merges the newest segments as far as sizes ask for it, or all of them. Returns the version."""
        number, listed = self.log.read()
        parts = listed.get("segments", [])
        first = 0 if whole else merge_from([max(1, p["tokens"]) for p in parts])
        if not parts or (first >= len(parts) - 1 and not (whole and listed["dead"])):
            return number
        old, merged = parts[:first], parts[first:]
        gen = number
        own = {kind: self._alive(self._all(merged, kind, self._type(listed)), listed, merged) for kind in ("postings", "lengths")}
        tasks = tasks_for(self.spark, sum(p["tokens"] for p in merged), textindex.EACH)
        new = self._segment(self._postings(own["postings"].repartitionByRange(tasks, "term", "episode_id")), own["lengths"], gen)
        left = old + ([new] if new else [])
        oldest = min((p["gen"] for p in left), default=gen)
        stay = [p for p in listed["dead"] if p["gen"] > oldest]
        late = [p for p in stay if p["gen"] >= merged[0]["gen"]]
        if len(late) > 1:  # one table of those that came with the merged segments: it hits older ones alone
            name = self.log.fresh()
            self._all(late, "dead", self._type(listed)).select("episode_id").distinct().write.parquet(self._path(name, "dead"))
            count = self.spark.read.parquet(self._path(name, "dead")).count()
            stay = [p for p in stay if p not in late] + [{"name": name, "gen": gen, "episodes": count}]
        return self.log.commit(number, listed | {"segments": left, "dead": stay})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes older versions and the files that only they name."""
        return self.log.vacuum(lambda listed: [p["name"] for k in ("segments", "dead") for p in listed.get(k, [])], keep)


def merge_from(sizes: list[int]) -> int:
    """Of sizes, oldest first: the place from which on a merge leaves each larger than all after it together."""
    first, after = len(sizes), 0
    for i in reversed(range(len(sizes))):
        if sizes[i] <= after:
            first = i
        after += sizes[i]
    return first


def _schema(kind: str, ids: DataFrame) -> str:
    own = f"episode_id {ids.schema['episode_id'].dataType.simpleString()}"
    return {"postings": f"term string, {own}, seq bigint, positions array<int>, dl int", "lengths": f"{own}, segments bigint, tokens bigint", "terms": "term string, n bigint", "dead": own}[kind]
