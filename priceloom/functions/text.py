"""Column functions over product titles and queries (OP-58 to OP-60, OP-63, OP-64, OP-67 to OP-69).

Digits and letters in patterns are ASCII; white space is Unicode's, as scraped titles are full of no-break
spaces.  A null input gives null, except for the array functions, which give an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents that are folded, and names that mean drywall, in order of replacement.
ACCENTED, PLAIN = "áéíóú", "aeiou"
DRYWALL_NAMES = ["yeso-carton", "yesocarton", "volcanita", "vulcanita"]

#: White space in a pattern: Java's and DuckDB's own class is ASCII only.
WHITE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a list, for functions that take one.
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# The quantity grammar.
UNIT_COUNT = r"(\d+)\s*(?:unidades|unidad\(es\)|unidad|unds|und|un\b|u\b|pcs|pz|piezas|uds)"
CONTAINER_COUNT = r"(?:caja|pack|bolsa|balde)\s*(?:de\s*)?(\d+)"

# The size grammar, in the order in which it is tried.
SIZE_BY = r'(\d+(?:/\d+)?)\s*x\s*(\d+[ -]\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)(?:\s*(pulgada|mm|"))?'
SIZE_INCH_AND_MM = r'(\d+(?:-\d+/\d+|/\d+)?)\s*"\s*(\d+(?:\.\d+)?)\s*mm'
SIZE_INCH = r'(\d+[ -]\d+/\d+|\d+/\d+)(?:\s*(pulgada|"))'
SIZE_MM = r"(\d+(?:\.\d+)?)\s*mm"

# Fixed value: a number.
NUMBER = r"(\d+(?:[.,]\d+)?)"

UNIT_COUNT, CONTAINER_COUNT, SIZE_BY, SIZE_INCH_AND_MM, SIZE_INCH, SIZE_MM = (p.replace(r"\s", WHITE) for p in (UNIT_COUNT, CONTAINER_COUNT, SIZE_BY, SIZE_INCH_AND_MM, SIZE_INCH, SIZE_MM))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def normalize(c: Column) -> Column:
    """Lower case, vowels without accents, one name for drywall, a space between digits and letters."""
    out = F.translate(F.lower(c), ACCENTED, PLAIN)
    for name in DRYWALL_NAMES:
        out = F.replace(out, F.lit(name), F.lit("drywall"))
    out = F.regexp_replace(out, "([0-9])([a-z])", "$1 $2")
    return strip(F.regexp_replace(out, "([a-z])([0-9])", "$1 $2"))


def numbers(c: Column) -> Column:
    """The distinct numbers of a text, as strings."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))), F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """The distinct white-space separated words of a text."""
    parts = F.split(F.translate(c, WHITE_CHARS, " " * len(WHITE_CHARS)), " ")
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def quantity(title: Column) -> Column:
    """Pieces in the package: a counted unit, else a container's number, else 1; never below 1.

    Numbers too large for a long count as the largest long.
    """
    t = F.replace(F.lower(title), F.lit("."), F.lit(""))
    digits = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (UNIT_COUNT, CONTAINER_COUNT)])
    number = F.when(digits.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1)))
    return F.when(title.isNotNull(), F.greatest(F.lit(1).cast("bigint"), number))


def size(title: Column, quotes_are_inches: bool = False) -> Column:
    """The size in a title by the first pattern that is found, or an empty string.

    ``quotes_are_inches``: two single quotes stand for an inch mark.
    """
    t = F.lower(title)
    if quotes_are_inches:
        t = F.replace(t, F.lit("''"), F.lit('"'))
    t = F.replace(t, F.lit('"'), F.lit(' " '))

    def found(pattern: str, shape) -> Column:
        one = F.regexp_extract(t, pattern, 1)
        return F.when(one != "", shape(one, lambda: F.regexp_extract(t, pattern, 2)))

    return F.when(title.isNotNull(), F.coalesce(
        found(SIZE_BY, lambda a, b: F.replace(F.concat(a, F.lit("x"), b(), F.lit('"')), F.lit(" "), F.lit(""))),
        found(SIZE_INCH_AND_MM, lambda a, b: F.concat(a, F.lit('" y '), b(), F.lit("mm"))),
        found(SIZE_INCH, lambda a, b: F.concat(a, F.lit('"'))),
        found(SIZE_MM, lambda a, b: F.concat(a, F.lit("mm"))),
        F.lit(""),
    ))


def product_numbers(title: Column, size_text: Column) -> Column:
    """The numbers of a product: those of its title and of its size."""
    return numbers(F.concat_ws(" ", title, size_text))
