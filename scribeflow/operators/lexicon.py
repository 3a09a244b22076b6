"""Word statistics: frequent words and their places in a sky."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import formats as X

#: Words too common to be shown. Fixed values.
STOP_WORDS = tuple(
    """the be to of and in that have it for not on with he as you do at this but his by from they we say her she or an
    will my one all would there their what so up out if about who get which go me when make can like time no just him know take
    people into year your good some could them see other than then now look only come its over think also back after use two how our
    work first well way even new want because any these give day most us was were been had are has did got said is am does done
    going being having yeah yes right okay oh uh um mean thing things kind really actually gonna lot don didn isn wasn aren
    doesn wouldn couldn very much still too here where why let down should own while those both each through same off before must between
    such may again might never every more put another always many great little big old few around long made away keep went tell called
    came thought part whole something nothing everything anything someone everyone myself himself themselves yourself
    gotta wanna kinda sorta cause though""".split()
)


def words(segments: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """word: every word of three letters or more that isn't a stop word; letters a-z, inner apostrophes and hyphens."""
    rows = segments.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z](?:[a-z'-]*[a-z])?"), 0)).alias("word"))
    return rows.where((F.length("word") >= 3) & ~F.col("word").isin(*stop))


def word_counts(segments: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    return words(segments, stop).groupBy("word").agg(F.count("*").alias("count"))


def constellation(segments: DataFrame, top: int = 1500, stop: tuple[str, ...] = STOP_WORDS, labels: int = 500) -> DataFrame:
    """word, count, ra, dec, labelled of the top words (ties by word); the first labels of them carry a label."""
    best = word_counts(segments, stop).orderBy(F.desc("count"), "word").limit(top)
    rank = F.row_number().over(W.orderBy(F.desc("count"), "word"))  # of the top rows alone
    return best.withColumn("_r", rank).select("word", "count", X.right_ascension(F.col("word")).alias("ra"), X.declination(F.col("word")).alias("dec"), (F.col("_r") <= labels).alias("labelled"))
