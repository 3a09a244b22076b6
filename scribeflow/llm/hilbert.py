"""Operator 7: sharding along a Hilbert curve, with DataFrame functions alone.

Several metadata dimensions are quantised to a few bits each; the cell's index
on the Hilbert curve orders the rows, so each shard is a run of the curve and
covers a compact box of every dimension: a reader that filters on any of them
skips most files. Rows are placed by the law `rows`: shard counts are at most
one apart, and slots run from 0 without gaps.

The global order comes from range partitions: their bounds include the text's
checksum and the id, so a group of copies that holds a third of all rows is
spread over many partitions, while copies stay neighbours on the curve. Only
one row per partition (a count) is summed in one place.

Sizes take two cells to a doubling: at 6 bits, up to 4 GB, so the longest texts
still have cells of their own.

Defined cases: a null text has no bytes and size 1, checksum 0; null
dimensions, and columns that docs lacks, fall in cell 0; rows of one cell are
ordered by checksum, size and id, and rows that tie in all of these stand in
any order; repeated rows are placed each; a text's length moves no more than
its cell and size, since texts themselves never leave their task; other columns
are never read, whatever their names; an empty table gives an empty result;
fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeflow.runtime import cut_lineage, tasks_for


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """For each state and cell of a dims-dimensional Hilbert curve: its digit, and the state within it.

    A state is an entry corner e and a direction d, numbered e * dims + d.
    """
    mask = (1 << dims) - 1

    def left(x: int, r: int) -> int:
        r %= dims
        return ((x << r) | (x >> (dims - r))) & mask

    def right(x: int, r: int) -> int:
        return left(x, dims - r % dims)

    def gray_inverse(g: int) -> int:
        x = g
        while g := g >> 1:
            x ^= g
        return x

    def entry(i: int) -> int:
        i = 2 * ((i - 1) // 2)
        return 0 if i < 0 else i ^ (i >> 1)

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def direction(i: int) -> int:
        return 0 if i == 0 else trailing_ones(i - 1 if i % 2 == 0 else i) % dims

    digit, state = [], []
    for e in range(1 << dims):
        for d in range(dims):
            for cell in range(1 << dims):
                w = gray_inverse(right(cell ^ e, d + 1))
                digit.append(w)
                state.append((e ^ left(entry(w), d + 1)) * dims + (d + direction(w) + 1) % dims)
    return digit, state


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the curve of the cell whose coordinates (bits bits each, from 0) are dims."""
    n = len(dims)
    digit, state = (F.array(*map(F.lit, t)) for t in curve_table(n))
    place = F.array(*[d.cast("int") for d in dims])

    def step(acc: Column, level: Column) -> Column:
        cell = F.aggregate(F.transform(place, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, level).bitwiseAND(1), i)), F.lit(0), lambda a, b: a + b)
        at = acc["s"] * (1 << n) + cell
        return F.struct(F.get(state, at).alias("s"), (acc["h"] * (1 << n) + F.get(digit, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def hashed_cell(value: Column, bits: int) -> Column:
    """A category's cell: equal values share it; null: 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("int")


def log_cell(value: Column, bits: int) -> Column:
    """A size's cell, two to each doubling; null: 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.coalesce(value, F.lit(0)).cast("double") + 1))).cast("int")


def shard(docs: DataFrame, shards: int = 8, bits: int = 6, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve (the index)."""
    spark = docs.sparkSession
    names = set(docs.columns)
    cell = lambda c: hashed_cell(F.col(c), bits) if c in names else F.lit(0)
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), hilbert_index([cell("lang"), log_cell(size, bits), cell("source")], bits).alias("curve"))
    order = ["curve", "text_crc32", "size", "doc_id"]
    parts = partitions or tasks_for(spark, docs.count(), 2_000_000)
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # range bounds are sampled: the counts below must be those of the rows that are returned
    placed = cut_lineage(placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))
    rank = F.col("start") + F.col("at")
    exact = F.call_function("div", rank * shards, F.col("total"))
    first = F.call_function("div", F.col("shard") * F.col("total") + shards - 1, F.lit(shards))
    return (
        placed.join(F.broadcast(starts), "part")
        .withColumn("shard", exact.cast("int"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
