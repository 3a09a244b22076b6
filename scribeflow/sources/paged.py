"""A Spark data source over a paged registry: partitions are runs of pages, filters and order go to the server.

The transport is a function, given by its import path, so that tests and
offline runs read canned pages: fetch(category, offset, limit, where) returns a
list of row dicts; an empty list ends a category. With the option order it is
asked fetch(category, offset, limit, where, order). A transport that raises
Busy is asked again after pauses of 2, 5 and 10 seconds (option pauses); one
that raises QuotaReached ends its partition: rows read so far stand.

A quota of requests (option quota) is split over the partitions before they
are read, so all tasks together never ask more often, whatever the server says. A
probe (option, the import path of probe(category, where) -> rows) tells how
many rows a category has, at one request each; without it a category counts as
having most rows. harvest keeps, in a stored table, where each category
stands, so the next run starts where the last one ended.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from scribeflow.operators.keyed import KeyedTable
from scribeflow.runtime import written


class Busy(Exception):
    """The server asks for a pause."""


class QuotaReached(Exception):
    """The server answers no more today."""


class Category(InputPartition):
    """A category's rows from first on, up to end, by so many requests at most."""

    def __init__(self, name: str, first: int = 0, end: int = 1 << 62, requests: int = 1 << 62):
        super().__init__((name, first))
        self.name, self.first, self.end, self.requests = name, first, end, requests


def resolve(path: str):
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


class PagedRegistry(DataSource):
    """Options: fetch (import path), categories (comma-separated), page_size, most (rows a category), columns (DDL), order, pauses,
    pages (with most: pages of a partition; a category is one partition without it), quota (requests of all partitions),
    probe (import path), starts (JSON: a category's first row; those below 0 are passed over), plan (JSON: what partitions to read),
    tagged (any value: the schema's last two columns are the category and the place of the row; an empty page at place n is a row
    of nulls at place -1 - n)."""

    @classmethod
    def name(cls) -> str:
        return "paged_registry"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), [f.name for f in schema.fields])


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns, self.where, self.totals = options, columns, {}, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.where[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if "plan" in self.options:
            return [Category(*own) for own in json.loads(self.options["plan"])]
        names, most = self.options.get("categories", "").split(","), int(self.options.get("most", 1 << 62))
        size, starts = int(self.options.get("page_size", 50)), json.loads(self.options.get("starts", "{}"))
        quota, pages = int(self.options.get("quota", 1 << 62)), int(self.options.get("pages", 0))
        out: list[InputPartition] = []
        for i, name in enumerate(names):
            first, end = starts.get(name, 0), most
            if first < 0:
                continue
            if "probe" in self.options:
                if quota < 2:  # a probe without a page is of no use
                    break
                end, quota = min(most, resolve(self.options["probe"])(name, self.where)), quota - 1
            self.totals[name] = end
            wanted = -(-max(0, end - first) // size) if end < 1 << 62 else max(1, quota // (len(names) - i))
            allowed = min(quota, wanted)
            quota -= allowed
            end = min(end, first + allowed * size) if "quota" in self.options else end
            step = pages * size if pages and end < 1 << 62 else max(1, end - first)
            for at in range(first, end, step):
                own = min(step, end - at)
                out.append(Category(name, at, at + own, -(-own // size) if "quota" in self.options else 1 << 62))
        return out

    def _page(self, fetch, left: list[int], *asked) -> list[dict]:
        """A page; left holds the requests that its partition may still make."""
        order = self.options.get("order")
        for pause in [*map(float, self.options.get("pauses", "2,5,10").split(",")), None]:
            if not left[0]:
                raise QuotaReached
            left[0] -= 1
            try:
                return fetch(*asked, self.where, order) if order else fetch(*asked, self.where)
            except Busy:
                if pause is None:
                    raise
                time.sleep(pause)

    def read(self, partition: Category | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        fetch, size, at, left = resolve(self.options["fetch"]), int(self.options.get("page_size", 50)), partition.first, [partition.requests]
        tagged = "tagged" in self.options
        columns = self.columns[:-2] if tagged else self.columns
        while at < partition.end:
            try:
                rows = self._page(fetch, left, partition.name, at, min(size, partition.end - at))
            except QuotaReached:
                return
            if not rows:
                if tagged:
                    yield (*(None for _ in columns), partition.name, -1 - at)
                return
            for i, r in enumerate(rows):
                yield (*(r.get(c) for c in columns), *((partition.name, at + i) if tagged else ()))
            at += len(rows)


#: Where a category stands: the first row that isn't read yet, and whether all are.
PROGRESS = "category string, next long, complete boolean"


def harvest(spark: SparkSession, options: dict, progress: KeyedTable, quota: int) -> DataFrame:
    """One run over the categories that aren't complete, from where each stands, within a quota of requests; the new rows.

    options: those of the source, with most. Rows carry category and place. A category stands at the first row that is
    missing; it is complete once its next page is empty, or nothing is left below most or what the probe said. Rows
    read beyond a gap (a part that was cut short before them) are read again, and are the same by category and place.
    """
    at = {r["category"]: r for r in progress.rows().collect()}  # a row a category
    names = options["categories"].split(",")
    starts = {c: -1 if c in at and at[c]["complete"] else at[c]["next"] if c in at else 0 for c in names}
    reader = PagedReader(options | {"starts": json.dumps(starts), "quota": str(quota)}, [])
    plan = [(p.name, p.first, p.end, p.requests) for p in reader.partitions()]
    source = spark.read.format(PagedRegistry.name()).options(**options | {"columns": f"{options['columns']}, category string, place long", "plan": json.dumps(plan), "tagged": "1"})
    rows = written(source.load(), "harvest")
    own = F.col("place").between(F.lit(0), F.lit(1 << 62))
    read = rows.where(own).select("category", F.explode(F.array("place", F.col("place") + 1)).alias("x"), "place")
    # a place that isn't read though the one before it is: the first of them ends the run without a gap
    ends = read.groupBy("category", "x").agg(F.max(F.col("x") == F.col("place")).alias("there")).where("NOT there").groupBy("category").agg(F.min("x").alias("next"))
    first = rows.where(own).groupBy("category").agg(F.min("place").alias("first"))
    empty = rows.where(~own).groupBy("category").agg(F.min(-1 - F.col("place")).alias("empty"))
    found = {r["category"]: r for r in ends.join(first, "category").join(empty, "category", "full").collect()}
    new = []
    for c in names:
        if starts[c] >= 0:
            r = found.get(c)
            stands = r["next"] if r and r["next"] is not None and r["first"] == starts[c] else starts[c]
            last = min(int(options["most"]), reader.totals.get(c, 1 << 62))
            new.append((c, stands, bool(stands >= last or (r and r["empty"] is not None and r["empty"] <= stands))))
    if new:
        progress.upsert(spark.createDataFrame(new, PROGRESS))
    return rows.where(own)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRegistry)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
