"""Operator 7: quality rules from repetition coverage.

The different words and lines of a chunk of texts are numbered; the hashes of all n-word windows, for
several n, are rolled from the word numbers.  Sorting them shows which windows may occur twice in a text,
their words decide, and a difference array over words gives the characters (code points) that lie inside
repeated windows.  Nothing leaves the row: there is no shuffle.

Null or empty text: zero counts, ``base_failed`` true.  Very long texts are measured whole; a task then
holds some 25 bytes for each of the text's.  Ties: of equal lines the first counts as new, and every
window of a repeated one counts as inside.  Repeated rows are judged alike, each by itself.  An empty table
gives an empty table.  The given columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Window lengths (words) with the share of word characters inside repeated windows that rejects.
COVERAGE = {5: 0.40, 8: 0.35, 10: 0.35}
#: Window lengths whose single most frequent window may cover this share of word characters.
TOP_WINDOW = {2: 0.20, 3: 0.18}
#: Share of characters in repeated lines that rejects; symbols per word that reject.
LINE_COVERAGE, SYMBOLS_PER_WORD = 0.30, 0.10
SYMBOLS = C._table(b"#*$%&|<>")

FIELDS = [(n, "bigint") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    ("base_failed", "boolean"), ("kept", "boolean"), ("line_coverage", "double"),
    *[(f"coverage_{n}", "double") for n in COVERAGE], *[(f"top_{n}", "double") for n in TOP_WINDOW],
]


def windows(codes: np.ndarray, owner: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length n, in order: n, the starts of the n-word windows inside one text, and a number for each
    window: equal for windows of the same words in the same text, and only for those.

    The hash of n words rolls on to n + 1 words; windows of one hash are compared word by word.
    """
    step, keys = C.U64(0x9E3779B97F4A7C15), C.mix(codes.astype(C.U64) + C.U64(1))
    h = C.mix(owner.astype(C.U64) + C.U64(1 << 32))
    for n in range(1, max(lengths) + 1):
        with np.errstate(over="ignore"):
            h = h[: max(0, len(codes) - n + 1)] * step + keys[n - 1 :]
        if n not in lengths:
            continue
        at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
        order = np.argsort(h[at], kind="stable")
        same = np.zeros(len(at), bool)
        same[1:] = h[at[order[1:]]] == h[at[order[:-1]]]
        x, y = at[order[np.flatnonzero(same) - 1]], at[order[same]]
        alike = owner[x] == owner[y]
        for k in range(n):
            alike &= codes[x + k] == codes[y + k]
        if alike.all():
            number = np.empty(len(at), np.int64)
            number[order] = np.cumsum(~same) - 1
        else:  # different windows share a hash
            number = np.unique(np.stack([owner[at], *(codes[at + k] for k in range(n))], 1), axis=0, return_inverse=True)[1].ravel()
        yield n, at, number


def measure(texts: pa.Array) -> dict:
    flat = C.Flat(texts)
    n, data = flat.n, flat.data
    point = C.is_point(data)
    starts, ends, owner = flat.runs(~C.IS_SPACE[data])
    chars = C.count_in(point, starts, ends)
    n_words, word_chars = C.sums_by(owner, n), C.sums_by(owner, n, chars)
    n_symbols = C.sums_by(flat.text_of(np.flatnonzero(SYMBOLS[data])), n)

    ls, le, lo = flat.lines()
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lo = ls[full], le[full], lo[full]
    first = np.unique(lo * (len(lo) + 1) + C.numbered(C.packed(data, ls, le))[0], return_index=True)[1]
    later = np.ones(len(ls), bool)
    later[first] = False
    n_dup_lines = C.sums_by(lo[later], n)
    line_chars = C.count_in(point, ls, le)
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=whole > 0)
    out = {"line_coverage": share(C.sums_by(lo[later], n, line_chars[later]), C.sums_by(lo, n, line_chars))}

    codes = C.numbered(C.packed(data, starts, ends))[0]
    del ls, le, lo, full, first, later, line_chars, point, starts, ends
    upto = np.concatenate([[0], np.cumsum(chars)])
    for k, at, number in windows(codes, owner, [*COVERAGE, *TOP_WINDOW]):
        count = np.bincount(number, minlength=1)
        if k in TOP_WINDOW:
            many = count[number] > 1
            covered = count[number[many]] * (upto[at[many] + k] - upto[at[many]])
            most = np.zeros(n, np.int64)
            np.maximum.at(most, owner[at[many]], covered)
            out[f"top_{k}"] = share(most, word_chars)
        if k in COVERAGE:
            at = at[count[number] > 1]
            cover = np.zeros(len(owner) + 1, np.int32)
            cover[at] += 1
            cover[at + k] -= 1
            inside = np.cumsum(cover[:-1]) > 0
            out[f"coverage_{k}"] = share(C.sums_by(owner[inside], n, chars[inside]), word_chars)
            if k == 8:
                repeat_words = C.sums_by(owner[inside], n)

    failed = (n_words < 20) | (100 * repeat_words > 30 * n_words)
    bad = failed | (n_symbols > SYMBOLS_PER_WORD * n_words) | (out["line_coverage"] > LINE_COVERAGE)
    for name, limits in (("coverage", COVERAGE), ("top", TOP_WINDOW)):
        for k, most in limits.items():
            bad |= out[f"{name}_{k}"] > most
    return out | {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~bad}


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, default all columns) with every measure and the verdict ``kept``."""
    return C.map_texts(df, text, keep or df.columns, lambda _, texts: measure(texts), FIELDS)
