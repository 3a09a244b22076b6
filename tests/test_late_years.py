"""Queries on dates, with episodes so many that the last ones are beyond the year 9999."""

from collections import Counter

import duckdb
import pytest

from scribeflow.plans import registry

QUERIES = ["cl07_off_days", "jn13_missing_weeks", "q03_range", "q03_timeline", "q06_on_this_day", "sf22_dates"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("late"))
    ids = [0, 17, 52, 200_000, *range(416_600, 416_700), *range(416_840, 416_850), 590_001, 590_285, 590_291]
    rows = [(i, f"the first of {i}\nand the last", "s") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_late_years_equal_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = Counter(map(tuple, registry.QUERIES[name](spark, folder).collect()))
    assert got == Counter(db.execute(registry.SQL[name]).fetchall())
    assert any("10003" in str(v) or "13327" in str(v) or "10000-" in str(v) for row in got for v in row)
