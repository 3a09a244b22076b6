"""Rows scraped from HTML by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scraped(pages: DataFrame, pattern: str, names: list[str], html: str = "html") -> DataFrame:
    """pages, a row for each match of pattern, with its groups as columns names."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    return pages.withColumn("_m", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names, strict=True)]))).select(*pages.columns, *[F.col(f"_m.{n}") for n in names])


def broadcasts(pages: DataFrame) -> DataFrame:
    """id, date of a show's listing pages: link then date within 2000 characters, or, on pages without, date then link; an id's first date counts."""
    ahead = scraped(pages, r'href="/broadcasts/(\d+)"[\s\S]{0,2000}?datetime="(\d{4}-\d{2}-\d{2})T', ["id", "date"])
    back = scraped(pages.join(ahead.select("page_id").distinct(), "page_id", "left_anti"), r'datetime="(\d{4}-\d{2}-\d{2})T[\s\S]{0,2000}?href="/broadcasts/(\d+)"', ["date", "id"])
    rows = ahead.select("page_id", "id", "date").unionByName(back.select("page_id", "id", "date"))
    return rows.groupBy("id").agg(F.min_by("date", "page_id").alias("date"))
