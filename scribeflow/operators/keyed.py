"""A stored table with keys, changed in place by copy on write: only the buckets that hold changed keys are read and written.

Rows lie in hash buckets of the columns by. A change finds the buckets of the
keys that it touches, reads the files of those alone, writes them anew under a
name of its own, and commits a list in which the other buckets keep their
files. The driver holds a name for each bucket, never rows; the number of buckets is
the table's, so choose it by size (a bucket of about 1 GB is a good file).

A bucket that outgrows the others, through one key with very many rows, is
written as several files and read by as many tasks.

With note, the list also holds something small about each bucket, so that a
reader knows which buckets it needs; a change by one who has no note leaves out
those of the buckets that it writes.

Defined cases: a null key is a key; of rows of a change with one key the last by
order (all columns, if none is given) counts; a change without rows commits no
version; columns that the table lacks are left out of what is written, columns
that new rows lack are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scribeflow.operators.snapshots import Conflict, Snapshots


def _same(a: DataFrame, b: DataFrame, keys: list[str], b_names: dict[str, str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[b_names[k]])
    return out


class KeyedTable:
    #: What the list shall hold about each bucket that is written: gets rows with their bucket, _b.
    note: Callable[[DataFrame], dict[str, object]] | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Snapshots(spark, folder)
        number, listed = self.log.read()
        if not number:
            raise ValueError(f"no table at {folder}")
        self.schema = StructType.fromJson(listed["schema"])
        self.by, self.buckets, self.pinned = listed["by"], listed["buckets"], number

    @staticmethod
    def create(rows: DataFrame, folder: str, by: list[str], buckets: int, note: Callable[[DataFrame], dict[str, object]] | None = None) -> KeyedTable:
        """A new table of rows, in buckets by some columns, which all later changes are found by."""
        spark, log = rows.sparkSession, Snapshots(rows.sparkSession, folder)
        if log.versions():
            raise ValueError(f"there is a table at {folder}")
        schema = StructType.fromJson({"type": "struct", "fields": [{**f, "nullable": True} for f in rows.schema.jsonValue()["fields"]]})
        name = log.fresh()
        files = _write(rows, f"{log.folder}/data/{name}", bucket_of(by, buckets))
        listed = {"schema": schema.jsonValue(), "by": by, "buckets": buckets, "files": {b: name for b in files}}
        if note:
            listed["notes"] = note(_placed(spark, schema, f"{log.folder}/data/{name}")) if files else {}
        log.commit(0, listed)
        out = KeyedTable(spark, folder)
        out.note = note
        return out

    def rows_of(self, files: dict[str, str]) -> DataFrame:
        """The rows of some buckets, by the files that a version lists for them."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.log.folder}/data/{name}/_b={b}" for b, name in files.items()])

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of its newest version, or of another that is kept."""
        return self.rows_of(self.log.read(version)[1]["files"])

    def pin(self) -> int:
        """Remembers the newest version: a pinned change fails (Conflict) if another came since, so it rests on what was read."""
        self.pinned = self.log.read()[0]
        return self.pinned

    def _touched(self, keys: DataFrame) -> set[str]:
        return {str(r[0]) for r in keys.select(bucket_of(self.by, self.buckets).alias("b")).distinct().collect()}  # at most one a bucket

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows in the buckets of some keys (the columns by): all of those keys, and others; nothing else is read."""
        hit = self._touched(keys)
        return self.rows_of({b: n for b, n in self.log.read()[1]["files"].items() if b in hit})

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], pinned: bool = False) -> int:
        """Puts make(rows) in place of the rows in all buckets that keys in touched (the columns by) fall in.

        make gets whole buckets, with rows of other keys too, and gives all that shall stand in those buckets. Returns the version.
        """
        number, listed = self._newest(pinned)
        hit = self._touched(touched)
        return self._put(number, listed, hit, make(self.rows_of({b: n for b, n in listed["files"].items() if b in hit}))) if hit else number

    def swap(self, files: dict[str, str], new: DataFrame, moved: bool = True, notes: dict[str, object] | None = None, pinned: bool = False) -> int:
        """Puts new in place of all rows of some buckets, which nobody may have changed since their files were listed (else Conflict). Returns the version.

        Without moved, new has each row of these files where it was read, so none is shuffled. notes, if known, spare a look at the new files.
        """
        number, listed = self._newest(pinned)
        if any(listed["files"].get(b) != name for b, name in files.items()):
            raise Conflict(f"{self.log.folder}: buckets changed since they were read")
        return self._put(number, listed, set(files), new, moved, notes)

    def _newest(self, pinned: bool) -> tuple[int, dict]:
        number, listed = self.log.read()
        if pinned and number != self.pinned:
            raise Conflict(f"{self.log.folder}: version {number} came after version {self.pinned}, which was read")
        return number, listed

    def _put(self, number: int, listed: dict, hit: set[str], new: DataFrame, moved: bool = True, notes: dict[str, object] | None = None) -> int:
        new = new.select([F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        name = self.log.fresh()
        made = _write(new, f"{self.log.folder}/data/{name}", bucket_of(self.by, self.buckets), moved)
        if not set(made) <= hit:
            raise ValueError("rows fell in buckets that weren't announced")
        if self.note and made and notes is None:
            notes = self.note(_placed(self.spark, self.schema, f"{self.log.folder}/data/{name}"))
        all_notes = {b: x for b, x in listed.get("notes", {}).items() if b not in hit} | {b: (notes or {})[b] for b in made if b in (notes or {})}
        files = {b: n for b, n in listed["files"].items() if b not in hit} | {b: name for b in made}
        return self.log.commit(number, listed | {"files": files} | ({"notes": all_notes} if self.note or "notes" in listed else {}))

    def upsert(self, rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, pinned: bool = False) -> int:
        """Rows whose keys are known replace those, others are added; of equal keys in rows the last counts."""
        keys = keys or self.by
        new = last_per_key(rows, keys, order)
        return self.change(new, lambda old: without(old, new, keys).unionByName(new.select([c for c in new.columns if c in old.columns]), allowMissingColumns=True), pinned)

    def insert_ignore(self, rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> int:
        """Rows whose keys aren't known are added."""
        keys = keys or self.by
        new = last_per_key(rows, keys, order)
        return self.change(new, lambda old: old.unionByName(without(new, old, keys).select([c for c in new.columns if c in old.columns]), allowMissingColumns=True))

    def patch(self, changes: DataFrame, keys: list[str] | None = None, only_if_present: tuple[str, ...] = ()) -> int:
        """Sets the columns of changes in the rows of known keys; in only_if_present null and '' change nothing."""
        keys = keys or self.by
        new = last_per_key(changes, keys)

        def make(old: DataFrame) -> DataFrame:
            names = {c: f"_new_{i}" for i, c in enumerate(new.columns)}
            side = new.select(*[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("_hit"))
            both = old.join(side, _same(old, side, keys, names), "left")
            out = []
            for c in old.columns:
                if c in keys or c not in names:
                    out.append(old[c])
                elif c in only_if_present:
                    out.append(F.coalesce(F.nullif(F.col(names[c]), F.lit("")), old[c]).alias(c))
                else:
                    out.append(F.when(F.col("_hit"), F.col(names[c])).otherwise(old[c]).alias(c))
            return both.select(out)

        return self.change(new, make)

    def delete(self, gone: DataFrame, keys: list[str] | None = None) -> int:
        """Removes the rows of the keys in gone."""
        keys = keys or self.by
        return self.change(gone, lambda old: without(old, gone, keys))

    def replace(self, rows: DataFrame, keys: list[str] | None = None) -> int:
        """Removes all rows of the keys in rows, then adds rows: all of them, so a key can have many."""
        keys = keys or self.by
        return self.change(rows, lambda old: without(old, rows, keys).unionByName(rows.select(old.columns)))

    def rename(self, renames: DataFrame, deletes: DataFrame, column: str) -> int:
        """Renames the values of a column (old, new) or deletes their rows (old); rows that become equal are one."""
        if self.by != [column]:
            raise ValueError("rename moves rows between buckets: the table must be kept by that column alone")
        old_names = renames.select("old").unionByName(deletes.select("old"))
        touched = old_names.unionByName(renames.select(F.col("new").alias("old"))).select(F.col("old").alias(column))

        def make(old: DataFrame) -> DataFrame:
            kept = without(old, deletes.select(F.col("old").alias(column)), [column])
            side = renames.select(F.col("old").alias("_old"), F.col("new").alias("_to")).dropDuplicates(["_old"])
            both = kept.join(side, kept[column].eqNullSafe(side["_old"]), "left")
            moved = F.when(F.col("_old").isNotNull(), F.col("_to")).otherwise(kept[column])
            return both.select([moved.alias(c) if c == column else kept[c] for c in old.columns]).distinct()

        return self.change(touched, make)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes older versions and the files that only they name."""
        return self.log.vacuum(lambda listed: [f"{name}/_b={b}" for b, name in listed["files"].items()], keep)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys (null is a key) aren't among those of gone."""
    names = {k: f"_gone_{i}" for i, k in enumerate(keys)}
    side = gone.select([F.col(k).alias(n) for k, n in names.items()]).distinct()
    return rows.join(side, _same(rows, side, keys, names), "left_anti")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key by order, then by all columns."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in [*(order or []), *rest]]) if rest else F.lit(0)
    return rows.groupBy(keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else rows.distinct()


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, bucket: Column, moved: bool = True) -> list[str]:
    """Writes rows by bucket, a bucket with very many as several files, and returns the buckets that have rows."""
    spark = rows.sparkSession
    placed = rows.withColumn("_b", bucket)
    (placed.hint("rebalance", "_b") if moved else placed).write.partitionBy("_b").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(place)]
    return [n.removeprefix("_b=") for n in names if n.startswith("_b=")]


def _placed(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """What _write wrote, with its bucket, _b, which no key is read for."""
    return spark.read.schema(StructType([*schema.fields, StructField("_b", IntegerType())])).parquet(path)
