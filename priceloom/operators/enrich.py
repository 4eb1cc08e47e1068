"""Detail enrichment and its resume logic (OP-03, OP-04, OP-18, OP-20, OP-29, OP-30, OP-39 to OP-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import envelope as E
from . import page_tree


def pending(base: DataFrame, done: DataFrame, key: str = "sku", order: list | None = None) -> DataFrame:
    """Rows of ``base`` whose key isn't done yet, the first of each key by ``order`` (default: as ``base`` lists them)."""
    if not order:
        return pending(base.withColumn("__at", F.monotonically_increasing_id()), done, key, [F.col("__at")]).drop("__at")
    rest = base.join(done.select(key).distinct(), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rest.withColumn("__n", first).where("__n = 1").drop("__n")


def remaining(base: DataFrame, done: DataFrame, key: str = "sku") -> DataFrame:
    """One row: base rows less distinct done keys (repeats can keep it above zero, stale keys push it below)."""
    n = base.agg(F.count(F.lit(1)).alias("n"))
    d = done.agg(F.countDistinct(key).alias("d"))
    return n.join(d).select((F.col("n") - F.col("d")).alias("remaining"))


def append(done: DataFrame, new: DataFrame) -> DataFrame:
    return done.unionByName(new, allowMissingColumns=True)


def merge(base: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """``base`` with columns added or replaced: the right side wins."""
    return base.withColumns(extra)


def one_page(details: DataFrame, url: str, html: str) -> DataFrame:
    """(url, __html): a page for each url, so that a url met twice doesn't repeat its products."""
    return details.groupBy(F.col(url)).agg(F.min(F.col(html)).alias("__html"))


def enrich_a(products: DataFrame, details: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Store A: description and specification table of each product's page; defaults where the page is missing."""
    products = products.drop("descripcion", "especificaciones")
    if products.isStreaming:
        return page_tree.details(products.join(one_page(details, url, html), url, "left"), "__html").drop("__html")
    # each page that a product has is parsed once, dealt to tasks by its url; after a broadcast of the pages few tasks would read the products
    wanted = one_page(details.join(products.select(url), url, "left_semi"), url, html)
    joined = products.join(page_tree.details(wanted, "__html").drop("__html"), url, "left")
    return joined.withColumns({"descripcion": F.coalesce("descripcion", F.lit(E.NO_DESCRIPTION)), "especificaciones": F.coalesce("especificaciones", F.create_map().cast("map<string,string>"))})


def enrich_b(products: DataFrame, details: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Store B: both columns are replaced where the page's JSON is found; otherwise the description is empty and the old specifications stay."""
    joined = products.join(one_page(details, url, html), url, "left")
    joined = joined.withColumn("__json", F.try_parse_json(E.envelope(F.col("__html"))))
    queries = F.try_variant_get("__json", "$.props.pageProps.dehydratedState.queries", "array<variant>")
    blocks = F.transform(queries, lambda q: F.try_variant_get(q, "$.state.data", "variant"))
    joined = joined.withColumn("__data", E.first_with_key(blocks, "specifications"))
    found, data = F.col("__json").isNotNull(), F.col("__data")
    none = F.create_map().cast("map<string,string>")
    new = F.coalesce(E.unwrap(F.try_variant_get(data, "$.specifications", "map<string,variant>")), none)
    return joined.withColumns({
        "descripcion_completa": F.when(found, F.coalesce(F.try_variant_get(data, "$.description", "string"), F.lit(""))).otherwise(""),
        "especificaciones": F.when(found, new).otherwise(F.col("especificaciones")),
    }).drop("__html", "__json", "__data")
