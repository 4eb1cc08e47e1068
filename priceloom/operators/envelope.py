"""Data embedded in pages: script envelope, JSON, specification tables (OP-12 to OP-23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions.text import strip

# Fixed value: the script element that holds the page's data.
ENVELOPE = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'

# Markers of store A's detail pages.
TABLE_CLASS, NAME_CLASS, VALUE_CLASS, TEXT_CLASS = "specification-table", "property-name", "property-value", "fb-product-information-tab__copy"
NO_DESCRIPTION = "Sin descripción"

CATALOGUE_A = "props struct<pageProps: struct<pagination: struct<count: bigint, perPage: bigint>, results: array<struct<displayName: string, skuId: string, brand: string, productId: string, prices: array<struct<price: array<string>>>>>>>"
CATALOGUE_B = "props struct<pageProps: struct<serverProductsResponse: struct<recordsFiltered: bigint, productList: array<struct<productName: string, sku: string, brand: string, prices: struct<normalPrice: double, offerPrice: double>, linkText: string, specifications: array<struct<name: string, values: array<string>>>>>>>>"


def envelope(html: Column) -> Column:
    """The JSON text of a page's data script; null where there is none."""
    return F.when(html.rlike(ENVELOPE), F.regexp_extract(html, ENVELOPE, 1))


def parse(text: Column, schema: str, strict: bool = False) -> Column:
    """JSON as a struct.  ``strict``: malformed text fails the job; otherwise it gives null."""
    out = F.from_json(text, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return out if strict else F.when(F.try_parse_json(text).isNotNull(), out)


def path(variant: Column, where: str, kind: str, default=None) -> Column:
    """A nested value of a variant, or ``default``."""
    out = F.try_variant_get(variant, where, kind)
    return out if default is None else F.coalesce(out, F.lit(default))


def first_with_key(items: Column, key: str) -> Column:
    """The first variant of an array whose object has ``key``; null if none has."""
    return F.get(F.filter(items, lambda q: F.try_variant_get(q, f"$.{key}", "variant").isNotNull()), F.lit(0))


def specifications(entries: Column) -> Column:
    """array<struct<name, values>> as a map: entries with a name and values, first value each, last name wins."""
    good = F.filter(entries, lambda e: F.coalesce(e["name"] != "", F.lit(False)) & (F.size(e["values"]) > 0))
    pairs = F.transform(good, lambda e: F.struct(e["name"].alias("k"), F.get(e["values"], F.lit(0)).alias("v")))
    return F.coalesce(last_wins(pairs), F.create_map().cast("map<string,string>"))


def last_wins(pairs: Column) -> Column:
    """array<struct<k, v>> as a map in which the last pair of a key counts (whatever the session's policy is)."""
    later = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(later)


def unwrap(values: Column) -> Column:
    """map<string, variant> as map<string, string>: the first element of a list, a scalar itself, other values as JSON."""
    return F.transform_values(values, lambda _, v: F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string"), F.to_json(v)))


def inner_text(fragment: Column) -> Column:
    """The text of an HTML fragment (approximate: a browser's layout is not known)."""
    return strip(F.regexp_replace(fragment, "(?s)<[^>]*>", ""))


def _element(html: Column, name: str) -> Column:
    pattern = rf'(?s)class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</(?:td|th|div|span|p)>'
    return F.when(html.rlike(pattern), inner_text(F.regexp_extract(html, pattern, 1)))


def has_table(html: Column) -> Column:
    return F.coalesce(html.rlike(rf'<table[^>]*class="(?:[^"]*\s)?{TABLE_CLASS}(?:\s[^"]*)?"'), F.lit(False))


def specification_table(html: Column) -> Column:
    """The name and value cells of the specification table's rows as a map; incomplete rows are skipped."""
    table = F.regexp_extract(html, rf'(?s)<table[^>]*class="(?:[^"]*\s)?{TABLE_CLASS}(?:\s[^"]*)?"[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    pairs = F.filter(F.transform(rows, lambda r: F.struct(_element(r, NAME_CLASS).alias("k"), _element(r, VALUE_CLASS).alias("v"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return F.when(has_table(html), last_wins(pairs)).otherwise(F.create_map().cast("map<string,string>"))


def description(html: Column) -> Column:
    """The product text on one line; the default where the page lacks it or its table."""
    pattern = rf'(?s)class="(?:[^"]*\s)?{TEXT_CLASS}(?:\s[^"]*)?"[^>]*>(.*?)</div>'
    text = strip(F.replace(inner_text(F.regexp_extract(html, pattern, 1)), F.lit("\n"), F.lit(" ")))
    return F.when(has_table(html) & html.rlike(pattern), text).otherwise(NO_DESCRIPTION)


def strip_tags(html: Column) -> Column:
    """Every tag as one space; the quote entity as a quote, no other entity."""
    return F.replace(F.regexp_replace(html, "<[^>]+>", " "), F.lit("&quot;"), F.lit('"'))
