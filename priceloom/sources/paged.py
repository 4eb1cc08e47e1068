"""A paged catalogue as a Spark data source, batch and stream (OP-01, OP-02).

    paged.register(spark, "shop", paged.Site(...))
    spark.read.format("shop").load().where("page_no BETWEEN 3 AND 7")

Page 1 tells how many pages there are; each partition reads a range of page numbers.  Comparisons of ``page_no`` with numbers are
pushed down, so that other pages are not fetched.  As a stream, the offset is
the number of pages told so far: a batch reads the pages that have come since.

A page that can't be fetched has a null html, which the extractors read as a page without data.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "page_no int, url string, html string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Site:
    """``get`` fetches a url (html or None), ``later`` holds ``{n}``, ``count`` tells the pages from page 1's html."""

    get: Callable[[str], str | None]
    first: str
    later: str
    count: Callable[[str], int]
    pause_s: float = 0.0

    def url(self, n: int) -> str:
        return self.first if n == 1 else self.later.replace("{n}", str(n))

    def page(self, n: int) -> str | None:
        try:
            return self.get(self.url(n))
        except Exception:  # noqa: BLE001  any failure of the caller's function is a page without data
            return None

    def pages(self) -> int:
        """At least 1, as the first page is there to be read."""
        html = self.page(1)
        return max(1, self.count(html)) if html is not None else 1


@dataclass
class Range(InputPartition):
    start: int
    stop: int


def split(wanted: list[int], most: int) -> list[Range]:
    """Runs of consecutive page numbers, of ``most`` pages at most."""
    out: list[Range] = []
    for n in wanted:
        if out and out[-1].stop == n and n - out[-1].start < most:
            out[-1].stop = n + 1
        else:
            out.append(Range(n, n + 1))
    return out or [Range(1, 1)]  # Spark wants a partition


def _read(site: Site, part: Range) -> Iterator[pa.RecordBatch]:
    for n in range(part.start, part.stop):
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([site.url(n)]), pa.array([site.page(n)], pa.string())], names=["page_no", "url", "html"])
        if site.pause_s:
            time.sleep(site.pause_s)


class Reader(DataSourceReader):
    def __init__(self, site: Site, per_task: int):
        self.site, self.per_task, self.tests = site, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep comparisons of the page number with a number; hand back the others."""
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Range]:
        low = max([1, *(t[0] for t in self.tests)])
        high = min([t[1] for t in self.tests], default=None)
        if high is not None and high < low:
            return split([], self.per_task)
        last = self.site.pages() if high is None or high > 1 else 1
        wanted = [n for n in range(low, min(last, high if high is not None else last) + 1) if all(t[2] is None or n in t[2] for t in self.tests)]
        return split(wanted, self.per_task)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.site, part)


def _test(f: Filter) -> tuple[int, int | float, frozenset | None] | None:
    """(least, greatest, members) that the filter lets through; None if it is not about the page number."""
    if getattr(f, "attribute", None) != ("page_no",):
        return None
    if isinstance(f, In):
        members = frozenset(v for v in f.value if v is not None)
        return (min(members, default=1), max(members, default=0), members)
    if not isinstance(getattr(f, "value", None), int):
        return None
    kinds = {EqualTo: (f.value, f.value), GreaterThan: (f.value + 1, float("inf")), GreaterThanOrEqual: (f.value, float("inf")), LessThan: (1, f.value - 1), LessThanOrEqual: (1, f.value)}
    return (*kinds[type(f)], None) if type(f) in kinds else None


class StreamReader(DataSourceStreamReader):
    def __init__(self, site: Site, per_task: int):
        self.site, self.per_task = site, per_task

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.site.pages()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return split(list(range(start["pages"] + 1, end["pages"] + 1)), self.per_task)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.site, part)

    def commit(self, end: dict) -> None:
        pass  # pages stay where they are


def register(spark: SparkSession, name: str, site: Site) -> None:
    """Make ``site`` readable as the format ``name`` (and let the session push filters down to such sources)."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source(name, site))


def source(name: str, site: Site) -> type[DataSource]:
    """A data source to register; its option ``pages_per_task`` (default 16) bounds a partition."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _per_task(self) -> int:
            return max(1, int(self.options.get("pages_per_task", 16)))

        def reader(self, schema) -> Reader:
            return Reader(site, self._per_task())

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(site, self._per_task())

    return Paged
