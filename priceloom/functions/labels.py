"""Ordered keyword rules compiled to one CASE expression (OP-61, OP-62)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def deduce(text: Column, groups: list[tuple[str, list[str]]], default: str, whole_words: list[str] | None = None) -> Column:
    """The label of the first group with a word in the lower-cased text, else ``default``."""
    low, whole = F.lower(text), set(whole_words or [])
    out = None
    for label, words in groups:
        hit = None
        for word in words:
            one = low.rlike(rf"\b{re.escape(word)}\b") if word in whole else low.contains(word)
            hit = one if hit is None else hit | one
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def attribute(text: Column, name: str, store: str) -> Column:
    """The attribute ``uso``, ``punta``, ``cabeza`` or ``material`` by the rules of a store (``a`` or ``b``)."""
    return deduce(text, V.GROUPS[store][name], V.DEFAULTS[name], V.WHOLE_WORDS[store])


def is_product(title: Column) -> Column:
    """Whether a title holds one of the product words (OP-36)."""
    return F.lower(title).rlike("|".join(V.PRODUCT_WORDS))
