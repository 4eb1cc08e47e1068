"""The text functions as SQL functions of the session or of its catalog.

Their bodies are the SQL of the library's own expressions, so a query in SQL is planned as one in Python is: inlined,
without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.operators import envelope as E

#: Functions of one text: name, result and body.
TEXT = {
    "title_normalized": ("STRING", X.normalize),
    "title_numbers": ("ARRAY<STRING>", X.numbers),
    "title_quantity": ("BIGINT", X.quantity),
    "title_size": ("STRING", X.size),
    "title_size_quoted": ("STRING", lambda c: X.size(c, quotes_are_inches=True)),
    "text_stripped": ("STRING", X.strip),
    "html_stripped": ("STRING", E.strip_tags),
    "page_data": ("STRING", E.envelope),
}

#: Rows (key, value) of a specification list: entries with a name and values, the first value of each, the last entry of a name.
SPECIFICATIONS = """(entries ARRAY<STRUCT<name: STRING, values: ARRAY<STRING>>>) RETURNS TABLE (key STRING, value STRING)
RETURN SELECT explode(map_from_entries(transform(
  filter(entries, (e, i) -> coalesce(e.name <> '' AND size(e.values) > 0, false)
    AND NOT exists(slice(entries, i + 2, size(entries)), later -> coalesce(later.name = e.name AND size(later.values) > 0, false))),
  e -> struct(e.name, e.values[0]))))"""


def sql_of(spark: SparkSession, body: Column) -> str:
    """The SQL of an expression of the text ``t``."""
    planned = spark.sql("SELECT CAST(NULL AS STRING) AS t").select(body.alias("x"))
    return planned._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, persistent: bool = False) -> list[str]:
    """Create the functions, for the session or (``persistent``) in the current schema of the catalog; returns their names."""
    kind = "FUNCTION" if persistent else "TEMPORARY FUNCTION"
    for name, (result, body) in TEXT.items():
        spark.sql(f"CREATE OR REPLACE {kind} {name}(t STRING) RETURNS {result} RETURN {sql_of(spark, body(F.col('t')))}")
    spark.sql(f"CREATE OR REPLACE {kind} specification_rows{SPECIFICATIONS}")
    return [*TEXT, "specification_rows"]
