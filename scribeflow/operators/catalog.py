"""Recording catalogues: discovery, schedule audit, rename plan, manifest and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import formats as X
from scribeflow.functions import names as N


def dated_files(files: DataFrame, show: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Files (filename, size) that are .mp3 and not in skip, with recording id and date (null: unparseable)."""
    rows = files.where(F.lower("filename").endswith(".mp3") & (~F.col("filename").isin(*skip) if skip else F.lit(True)))
    # a generator of one row: the long expression is evaluated once, and filters on its result aren't moved before it
    rows = rows.select("*", F.explode(F.array(N.recording_id(F.col("filename"), show, "scripts"))).alias("recording_id"))
    return rows.withColumn("date", X.id_date(F.col("recording_id")))


def best_per_date(dated: DataFrame, smallest: int = N.SMALL_FILE) -> DataFrame:
    """The preferred file of each date: large enough (else the largest), then by score, size, name."""
    by = W.partitionBy("date")
    big = F.col("size") >= smallest
    rows = dated.where("date IS NOT NULL").withColumns({"_any": F.max(big).over(by), "_score": N.file_score(F.col("filename"))})
    rows = rows.where(big | ~F.col("_any"))
    order = [F.when(F.col("_any"), F.col("_score")).desc_nulls_last(), F.desc("size"), F.desc("_score"), F.asc("filename")]
    return rows.withColumn("_r", F.row_number().over(by.orderBy(*order))).where("_r = 1").drop("_r", "_any", "_score")


def discover(files: DataFrame, done: DataFrame, show: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Recordings to process: the best file of each date whose id isn't among the done (recording_id)."""
    return best_per_date(dated_files(files, show, skip)).join(done.select("recording_id"), "recording_id", "left_anti")


def duplicate_dates(dated: DataFrame) -> DataFrame:
    return dated.where("date IS NOT NULL").groupBy("date").agg(F.count("*").alias("files")).where("files > 1")


def off_days(dates: DataFrame, weekday: int = 5) -> DataFrame:
    """Dates that aren't on the show's weekday (1: Sunday)."""
    return dates.select("date").distinct().where(F.dayofweek("date") != weekday)


def missing_weeks(dates: DataFrame, until: str | None = None) -> DataFrame:
    """Thursdays from the earliest date until a day (else the latest date) on which there is no recording."""
    span = dates.agg(F.min("date").alias("a"), (F.lit(until).cast("date") if until else F.max("date")).alias("b"))
    return span.select(F.explode(X.thursdays(F.col("a"), F.col("b"))).alias("date")).join(dates.select("date").distinct(), "date", "left_anti")


def rename_plan(files: DataFrame, show: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """src, dest, status (rename, same, collision): `<Show> date.mp3`, numbered within a date by time of day.

    Files (filename, size, born: date) without a date in their name take the day they were born, after their own stem.
    """
    slug = "-".join(show.split()).lower()
    rows = dated_files(files, show, skip)
    day = F.when(F.col("recording_id") != N.stem(F.col("filename")), F.col("date")).otherwise(F.when(F.col("filename").rlike(rf"^{slug}_"), F.col("date")))
    rows = rows.withColumns({"_day": day, "_min": N.sort_minutes(F.col("filename"), slug)})
    key = F.coalesce(F.lpad(F.col("_min").cast("string"), 5, "0"), N.stem(F.col("filename")))
    by = W.partitionBy("_day")
    known = rows.where("_day IS NOT NULL").withColumns({"_k": F.row_number().over(by.orderBy(key, "filename")), "_n": F.count("*").over(by)})
    date = F.date_format("_day", "yyyy-MM-dd")
    known = known.select(F.col("filename").alias("src"), F.concat(F.lit(f"{show} "), date, F.when(F.col("_n") > 1, F.concat(F.lit(" "), F.col("_k"))).otherwise(""), F.lit(".mp3")).alias("dest"))
    other = rows.where("_day IS NULL").select(F.col("filename").alias("src"), F.concat(N.stem(F.col("filename")), F.lit(f" {show} "), F.date_format("born", "yyyy-MM-dd"), F.lit(".mp3")).alias("dest"))
    plan = known.unionByName(other).withColumn("_c", F.count("*").over(W.partitionBy("dest")))
    return plan.select("src", "dest", F.when(F.col("_c") > 1, "collision").when(F.col("src") == F.col("dest"), "same").otherwise("rename").alias("status"))


def merged_listings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two listings (date, recording_id, file) by date; the right one wins."""
    r = right.select("date", F.col("recording_id").alias("_i"), F.col("file").alias("_f"))
    both = left.join(r, "date", "full_outer")
    hit = F.col("_i").isNotNull()
    return both.select("date", F.when(hit, F.col("_i")).otherwise(F.col("recording_id")).alias("recording_id"), F.when(hit, F.col("_f")).otherwise(F.col("file")).alias("file"))


def manifest(listing: DataFrame, completed: DataFrame, failed: DataFrame, skipped: DataFrame, transcripts: DataFrame, key: str = "recording_id") -> DataFrame:
    """listing with status: completed, failed, skipped, completed (a transcript alone), pending; the first that holds."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = listing
    for df, name in ((completed, "_c"), (failed, "_f"), (skipped, "_s"), (transcripts, "_t")):
        rows = rows.join(flag(df, name), key, "left")
    status = F.when(F.col("_c"), "completed").when(F.col("_f"), "failed").when(F.col("_s"), "skipped").when(F.col("_t"), "completed").otherwise("pending")
    return rows.select(*listing.columns, status.alias("status"))


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: total, a count for each status, and the percentage that is completed."""
    per = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "failed", "skipped")]
    out = rows.agg(F.count("*").alias("total"), *per)
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("completed") * 100 / F.col("total"), 1)).otherwise(0.0))


def finished_ids(completed: DataFrame, skipped: DataFrame, transcripts: DataFrame, key: str = "recording_id") -> DataFrame:
    """Ids that need no further run; failed ones are tried again."""
    return completed.select(key).union(skipped.select(key)).union(transcripts.select(key)).distinct()


def pruned_progress(progress: DataFrame, keyword: str) -> DataFrame:
    """Progress rows without the failed ones and those skipped for a reason that holds keyword: these run again."""
    gone = (F.col("status") == "failed") | ((F.col("status") == "skipped") & F.lower(F.coalesce("reason", F.lit(""))).contains(keyword.lower()))
    return progress.where(~gone)


def time_left(timings: DataFrame, remaining: int, default_minutes: int = 65) -> DataFrame:
    """minutes: the mean of seconds so far (a default without any) times what remains."""
    return timings.agg((F.coalesce(F.avg("seconds") / 60, F.lit(float(default_minutes))) * remaining).alias("minutes"))
