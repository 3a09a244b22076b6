"""Candidate places from the replies of three kinds of sources, as rows of one shape (model.CANDIDATE without its merge columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.functions import text as T

#: An element of a spatial tag query.
ELEMENT = "struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>"


def spatial(elements: DataFrame) -> DataFrame:
    """Candidates of the elements (category, element: JSON) of a spatial query: a node's own place, or the centre of other shapes.

    The address is house number and street (the street alone without a number), then the city.
    """
    e = elements.select("category", F.from_json("element", ELEMENT).alias("e"))
    tag = lambda k: F.col("e.tags")[k]
    street = F.when(~T.missing(tag("addr:housenumber")) & ~T.missing(tag("addr:street")), F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))).otherwise(tag("addr:street"))
    node = F.col("e.type") == "node"
    meta = F.map_concat(F.coalesce("e.tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("element_id"), F.col("e.id").cast("string"), F.lit("element_type"), F.col("e.type")))
    return e.select(
        F.coalesce(tag("name"), F.lit("")).alias("name"), F.nullif(T.join_parts(street, tag("addr:city")), F.lit("")).alias("address"),
        F.when(node, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("lat"), F.when(node, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("lng"),
        F.lit("spatial").alias("source"), "category", meta.alias("meta"),
    )


def registry(rows: DataFrame) -> DataFrame:
    """Candidates of registry rows (ord, name, street, city, state, start_date, end_date, row_id): of a name, whatever its case, the first row."""
    named = rows.withColumn("name", F.trim("name")).where(~T.missing(F.col("name")))
    first = F.row_number().over(W.partitionBy(F.lower("name")).orderBy("ord"))
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(F.col(k).cast("string"), F.lit("")).alias("v")) for k in ("start_date", "end_date", "row_id")]), lambda x: x["v"].isNotNull()))
    none = F.lit(None).cast("double")
    return named.withColumn("_r", first).where("_r = 1").select("name", T.join_parts(F.col("street"), F.col("city"), F.col("state")).alias("address"), none.alias("lat"), none.alias("lng"), F.lit("registry").alias("source"), F.lit("business").alias("category"), meta.alias("meta"))


def reviews(rows: DataFrame) -> DataFrame:
    """Candidates of review-site rows (ord, business_id, name, address_lines, lat, lng, category): the first row of each id; rows without an id go."""
    first = F.row_number().over(W.partitionBy("business_id").orderBy("ord"))
    own = rows.where(~T.missing(F.col("business_id"))).withColumn("_r", first).where("_r = 1")
    return own.select("name", F.nullif(F.array_join("address_lines", ", "), F.lit("")).alias("address"), "lat", "lng", F.lit("reviews").alias("source"), "category", F.create_map(F.lit("business_id"), F.col("business_id")).alias("meta"))
