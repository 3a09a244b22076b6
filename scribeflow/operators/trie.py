"""Many names in many texts: one pass over the texts for each block of names, with a trie over word ids.

The names lie in blocks of bounded size in the shared folder. A task loads a
block, gives each word of its names a number, and reads the texts' words as
numbers: only places whose word starts a name are walked along the trie. Texts
and words aren't shuffled or joined; hits leave the task that reads the text.

Defined cases: names without words, and null names, are found nowhere; a name is
found once in a text; without names the result is empty; texts without words
hold no name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from scribeflow.runtime import fresh_path, written

#: Names of a block, about; hits that a task hands on at once, with their texts.
BLOCK = 200_000
HANDED = 2_000
_END = -1


class Trie:
    """Names by the numbers of their words, in order."""

    def __init__(self, names: list[str], words: list[list[str]]):
        self.names, self.words, self.root = names, {}, {}
        for i, own in enumerate(words):
            node = self.root
            for w in own:
                node = node.setdefault(self.words.setdefault(w, len(self.words)), {})
            if own:
                node.setdefault(_END, []).append(i)
        self.starts = np.zeros(len(self.words) + 1, bool)
        self.starts[list(self.root)] = True

    def hits(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and names, once each, of the names that stand in the words of a row (ascending)."""
        coded = words.dictionary_encode()
        number = np.array([self.words.get(w, _END) for w in coded.dictionary.to_pylist()] + [_END], np.int64)
        ids = number[np.asarray(coded.indices)]
        places = np.flatnonzero(self.starts[ids])  # _END is the last flag, which is never set
        ids, rows, found = ids.tolist(), row.tolist(), set()
        for p in places.tolist():
            node, r = self.root, rows[p]
            while p < len(ids) and rows[p] == r:
                node = node.get(ids[p]) if ids[p] != _END else None
                if node is None:
                    break
                for i in node.get(_END, ()):
                    found.add((r, i))
                p += 1
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


@lru_cache(maxsize=1)
def _loaded(folder: str) -> Trie:
    store, base = pafs.FileSystem.from_uri(folder)
    rows = pq.read_table(base, filesystem=store, columns=["_name", "_t"], partitioning=None)
    return Trie(rows.column("_name").to_pylist(), rows.column("_t").to_pylist())


def _possible(names: DataFrame, texts: DataFrame) -> DataFrame:
    """The names (_name, _t) all of whose words are words of texts."""
    there = texts.select(F.explode("_t").alias("_w")).distinct()
    held = names.select("_name", F.explode(F.array_distinct("_t")).alias("_w")).join(there, "_w", "left_semi").groupBy("_name").agg(F.count("*").alias("_n"))
    return written(names.join(held, "_name").where(F.size(F.array_distinct("_t")) == F.col("_n")).drop("_n"), "possible")


def found(names: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of texts (without _t) with _name, once for each name whose words (_t of names: _name, _t) stand in a row among those of the text (_t).

    A block of names costs one pass over the texts; blocks are read by the tasks, one at a time. Names of more than one
    block are first narrowed to those of whose words each stands in some text, so passes follow what can be found.
    """
    spark = texts.sparkSession
    own = names.where(F.size("_t") > 0).select(F.col("_name").cast("string"), "_t").distinct()
    folder = fresh_path(spark, "names")
    count = own.count()
    if count > block:
        own = _possible(own, texts)
        count = own.count()
    blocks = max(1, -(-count // block))
    own.withColumn("_b", F.pmod(F.xxhash64("_name"), F.lit(blocks)).cast("int")).repartition("_b").write.partitionBy("_b").parquet(folder)
    at = texts.columns.index("_t")
    kind = StructType([f for f in texts.schema if f.name != "_t"] + [StructField("_name", StringType())])
    out = to_arrow_schema(kind)
    have = [r["_b"] for r in spark.read.parquet(folder).select("_b").distinct().collect()] if own.take(1) else []  # a number a block

    def one(place: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                trie = _loaded(place)
                for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                    lists = part.column(at)
                    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                    rows, hit = trie.hits(lists.flatten(), np.repeat(np.arange(len(size)), size))
                    for i in range(0, len(rows), HANDED):
                        take = pa.array(rows[i : i + HANDED])
                        columns = [c.take(take) for k, c in enumerate(part.columns) if k != at]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([trie.names[k] for k in hit[i : i + HANDED].tolist()], pa.string())], schema=out)

        return texts.mapInArrow(run, kind)

    parts = [one(f"{folder}/_b={b}") for b in sorted(have)]
    result = parts[0] if parts else spark.createDataFrame([], kind)
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
