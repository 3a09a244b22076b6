"""Connected components of an edge table, by alternating large and small stars.

Every round points each vertex at the smallest neighbour known (Kiveris et
al., "Connected Components in MapReduce and Beyond"). Rounds are joins and
minimum aggregates, so a vertex with very many edges is pre-aggregated before
the shuffle and its joins can be split; nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.runtime import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest vertex) for every vertex of edges (u, v: long) that isn't itself the smallest.

    Vertices without edges, and null ends, don't appear. Loops and repeated edges do no harm.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state or not new[0]:
            break
        state = new
        edges = cut_lineage(_stars(_stars(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
