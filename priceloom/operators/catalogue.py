"""Catalogue pages to product rows, for both stores (OP-14 to OP-17, OP-24 to OP-28).

Pages are rows (page_no, html); the fetching itself is outside.  Pages after the first one without data,
or beyond the page count told by page 1, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.session import keep

from .envelope import CATALOGUE_A, CATALOGUE_B, envelope, parse, specifications

# Defaults of absent fields, page sizes.
NO_TITLE, NO_SKU, NO_BRAND = "Sin titulo", "Sin SKU", "Sin marca"
PER_PAGE = {"a": 48, "b": 40}


def page_count_a(count: Column, per_page: Column) -> Column:
    """Pages of store A: the count over the page size, both of page 1; 1 if either is not positive."""
    per = F.coalesce(per_page, F.lit(PER_PAGE["a"]))
    return F.when((count > 0) & (per > 0), F.ceil(count / per)).otherwise(1).cast("bigint")


def page_count_b(records: Column) -> Column:
    return F.when(records > 0, F.ceil(records / PER_PAGE["b"])).otherwise(1).cast("bigint")


def prefix_until_empty(pages: DataFrame, page_no: str, good: Column, pages_told: Column, by: list[str] | None = None) -> DataFrame:
    """The pages before the first bad one and within the count told by page 1, for each ``by``.

    The first bad page and the count are one small aggregate, so no window sorts the pages.
    """
    by = by or []
    marked = pages.withColumn("__good", F.coalesce(good, F.lit(False)))
    stop = marked.groupBy(*by).agg(F.min(F.when(~F.col("__good"), F.col(page_no))).alias("__bad"), F.max(F.when(F.col(page_no) == 1, pages_told)).alias("__last"))
    joined = marked.join(stop, by) if by else marked.join(F.broadcast(stop))  # one row
    keep = F.col("__good") & (F.col(page_no) < F.coalesce("__bad", F.lit(2**62))) & (F.col(page_no) <= F.coalesce("__last", F.lit(1)))
    return joined.where(keep).drop("__good", "__bad", "__last")


def price_a(prices: Column, strict: bool = False) -> Column:
    """Store A's price: the first price's first text without its thousands dots; 0 without prices or without ``price``."""
    texts = F.get(prices, F.lit(0))["price"]
    text = F.replace(F.when(texts.isNull(), "0").otherwise(F.get(texts, F.lit(0))), F.lit("."), F.lit(""))
    number = text.cast("double") if strict else text.try_cast("double")
    return F.when(F.coalesce(F.size(prices), F.lit(0)) > 0, number).otherwise(F.lit(0.0))


def price_b(offer: Column, normal: Column) -> Column:
    """Store B's price: the offer, else the normal price, else 0; zero counts as absent."""
    return F.coalesce(F.nullif(offer, F.lit(0.0)), F.nullif(normal, F.lit(0.0)), F.lit(0.0))


def url_a(base: str, product_id: Column, title: Column, sku: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), product_id, F.translate(title, " /", "--"), sku)


def url_b(base: str, link: Column) -> Column:
    return F.concat(F.lit(base), F.coalesce(link, F.lit("")))


def parsed(pages: DataFrame, html: str, schema: str, where: list[str], strict: bool, once: bool) -> DataFrame:
    """``pages`` without html but with ``__p``, a part of its JSON.

    A generator makes the column: filters on it are not pushed below, so a page is not parsed again for each of them.
    ``once``: it is written to the shared folder, so that finding the last page and reading the rows parse a page once in all.
    """
    one = parse(envelope(F.col(html)), schema, strict)
    for name in where:
        one = one[name]
    found = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != html], F.explode(F.array(one)).alias("__p"))
    return keep(found, "pages") if once else found


def catalogue_a(pages: DataFrame, base_url: str, page_no: str = "page_no", html: str = "html", strict: bool = False, once: bool = False) -> DataFrame:
    """Store A's product rows (sku, marca, titulo, precio_clp, url) with page_no and pos."""
    body = parsed(pages, html, CATALOGUE_A, ["props", "pageProps"], strict, once)
    p = F.col("__p")
    good = F.coalesce(F.size(p["results"]), F.lit(0)) > 0
    kept = prefix_until_empty(body, page_no, good, page_count_a(p["pagination"]["count"], p["pagination"]["perPage"]))
    items = kept.select(page_no, F.posexplode(p["results"]).alias("pos", "r"))
    r = F.col("r")
    sku, title = F.coalesce(r["skuId"], F.lit(NO_SKU)), F.coalesce(r["displayName"], F.lit(NO_TITLE))
    return items.select(
        sku.alias("sku"), F.coalesce(r["brand"], F.lit(NO_BRAND)).alias("marca"), title.alias("titulo"), price_a(r["prices"], strict).alias("precio_clp"),
        url_a(base_url, F.coalesce(r["productId"], sku), title, sku).alias("url"), page_no, "pos",
    )


def catalogue_b(pages: DataFrame, base_url: str, page_no: str = "page_no", html: str = "html", strict: bool = False, once: bool = False) -> DataFrame:
    """Store B's product rows, with their specifications as a map."""
    body = parsed(pages, html, CATALOGUE_B, ["props", "pageProps", "serverProductsResponse"], strict, once)
    p = F.col("__p")
    good = F.coalesce(F.size(p["productList"]), F.lit(0)) > 0
    kept = prefix_until_empty(body, page_no, good, page_count_b(p["recordsFiltered"]))
    items = kept.select(page_no, F.posexplode(p["productList"]).alias("pos", "r"))
    r = F.col("r")
    return items.select(
        F.coalesce(r["sku"], F.lit(NO_SKU)).alias("sku"), F.coalesce(r["brand"], F.lit(NO_BRAND)).alias("marca"), F.coalesce(r["productName"], F.lit(NO_TITLE)).alias("titulo"),
        price_b(r["prices"]["offerPrice"], r["prices"]["normalPrice"]).alias("precio_clp"), url_b(base_url, r["linkText"]).alias("url"), specifications(r["specifications"]).alias("especificaciones"), page_no, "pos",
    )
