"""Paged catalogues and detail pages as tables (OP-01 to OP-04).

Fetching is a function of the caller (url -> html or None); Spark deals the urls to tasks.  Pages that
can't be fetched have a null html, which the extractors read as a page without data.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def page_urls(spark: SparkSession, first: str, later: str, last_page: int) -> DataFrame:
    """(page_no, url) of pages 1 to ``last_page``; ``later`` holds ``{n}`` for the page number."""
    n = F.col("page_no")
    return spark.range(1, last_page + 1).select(F.col("id").cast("int").alias("page_no")).withColumn("url", F.when(n == 1, first).otherwise(F.replace(F.lit(later), F.lit("{n}"), n.cast("string"))))


def fetch(urls: DataFrame, get: Callable[[str], str | None], url: str = "url", pause_s: float = 0.0, tasks: int | None = None) -> DataFrame:
    """``urls`` with html; ``tasks`` bounds how many pages are asked for at once, ``pause_s`` how fast by each."""
    rows = urls.repartition(tasks) if tasks else urls
    at = rows.columns.index(url)

    def run(batches):
        for batch in batches:
            out = []
            for u in batch.column(at).to_pylist():
                try:
                    out.append(get(u) if u is not None else None)
                except Exception:  # noqa: BLE001  any failure of the caller's function is a page without data
                    out.append(None)
                if pause_s:
                    time.sleep(pause_s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "html"])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias("html")).schema)


def details(products: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Products with the html of their own page, null where there is none; a page met twice doesn't repeat its products."""
    return products.join(pages.groupBy(url).agg(F.min("html").alias("html")), url, "left")


def page_number(url: Column) -> Column:
    """The page number in a listing's url, 1 without one."""
    return F.coalesce(F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("int"), F.lit(1))
