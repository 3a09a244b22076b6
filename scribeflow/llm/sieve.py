"""A bounded bitmap of wanted keys, to part the few rows that a join must decide from those that it can't concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 2 MB, whatever the input.
BITS = 1 << 24


def spare(name: str, taken: set[str]) -> str:
    """name, or with underscores before it until it isn't among taken (in lower case)."""
    while name in taken:
        name = "_" + name
    return name


def parted(rows: DataFrame, key: Column, wanted: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """rows whose key (long) may be among wanted (one column, long), and the rows whose key surely isn't; a null key isn't.

    Hashed keys set bits of a map that is broadcast. Once very many keys are
    wanted it lets more rows pass to the first part, never fewer, so a join
    of the first part alone gives what a join of all rows would.
    """
    taken = {c.lower() for c in rows.columns}
    bucket, bit, map_ = (spare(n, taken) for n in ("bucket", "bit", "map"))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    own = wanted.select(place(F.col(wanted.columns[0])).alias("p"))
    bitmap = own.groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(map_))
    p = place(key)
    marked = rows.withColumns({bucket: F.when(key.isNotNull(), F.bitmap_bucket_number(p)), bit: F.bitmap_bit_position(p)}).join(F.broadcast(bitmap), bucket, "left")
    byte = F.conv(F.hex(F.substring(map_, F.call_function("div", F.col(bit), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (F.col(bit) % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return marked.where(hit).select(rows.columns), marked.where(~hit).select(rows.columns)
