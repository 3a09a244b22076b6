"""Queries over whole tables, with dates of many files."""

from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from scribeflow.plans import registry

ORDERS, PARTS = 5200, 130
WHOLE = [
    "sf20_parse_id_a", "sf20_parse_id_b", "sf15_preference", "cl06_discover", "cl07_duplicate_dates", "cl08_rename_plan", "so05_parseable",
    "jn15_full_prefer_right", "jn16_status_cascade", "ag17_histogram", "pf26_pruned_progress", "sc05_byte_ranges",
]


def day(k):
    """Half of the orders are on one day."""
    return datetime(1995, 1, 1) + timedelta(days=0 if k % 16 < 8 else k * 37 % 1500)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, day(k)) for k in range(1, ORDERS + 1)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(1, PARTS + 1)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    return d


def rows_of(spark, folder, name):
    return Counter(map(tuple, registry.QUERIES[name](spark, folder).collect()))


@pytest.mark.parametrize("name", WHOLE)
def test_whole_equals_sql(spark, folder, name):
    sql = registry.SQL[name]
    assert "WHERE o_orderkey <" not in sql and "BETWEEN" not in sql
    db = duckdb.connect()
    for t in ("orders", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    frame = registry.QUERIES[name](spark, folder)
    got = Counter(map(tuple, frame.collect()))
    want = db.execute(sql)
    assert [c[0] for c in want.description] == frame.columns
    assert got == Counter(want.fetchall())


def test_whole_against_plain_python(spark, folder):
    keys = range(1, ORDERS + 1)
    status = lambda k: next((s for n, s in ((2, "completed"), (3, "failed"), (5, "skipped"), (7, "completed")) if k % n == 0), "pending")
    assert rows_of(spark, folder, "jn16_status_cascade") == Counter((k, status(k)) for k in keys)
    # files of one spelling, size and day are one; spellings 5 and 7 hold no date
    files = {(k % 8, k % 11, day(k).date()) for k in keys if k % 8 not in (5, 7)}
    per = Counter(str(f[2]) for f in files)
    assert rows_of(spark, folder, "cl07_duplicate_dates") == Counter((d, n) for d, n in per.items() if n > 1)
    ranges = Counter((k, i, i * 20971520, min(20971520, (k % 40 + 1) * 7_000_000 - i * 20971520)) for k in range(1, PARTS + 1) for i in range(-(-(k % 40 + 1) * 7_000_000 // 20971520)))
    assert rows_of(spark, folder, "sc05_byte_ranges") == ranges
