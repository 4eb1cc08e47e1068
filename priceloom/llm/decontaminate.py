"""Operator 2: benchmark decontamination by the q-gram lemma.

Texts and items are compared as UTF-8 bytes, A-Z lower-cased, runs of white space read as one
space.  An item of m bytes that occurs with e edits or fewer shares at least m - q + 1 - q*e of its
q-grams with the text, on diagonals (text position - item position) that differ by e at most.
Hits are counted in overlapping diagonal bands of width 2 * (e + 1), stepping by e + 1, so each such
occurrence lies wholly in one band.  Bands that reach the count are aligned with a banded,
semi-global edit distance and kept if it is within the budget e = floor(rate * m), or the largest
that leaves a count of at least one.  Items shorter than q are sought exactly; empty ones never match.

The benchmark is handled in blocks of about ``block_bytes`` of item text, each broadcast in turn (some 25
bytes of index for each of them); with several blocks the result so far is written between them, so
that a task holds one index at a time.  Texts are read in place and never shuffled.

Null and empty text: no leak.  Null items: ignored.  Very long texts are searched whole, a slice of their
q-grams at a time.  Ties: of an item's occurrences with equal edits in a text, one is reported.  Repeated rows
are judged alike; repeated items are reported once.  An empty table gives an empty table, an empty benchmark
no leaks.  The given columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

Q, RATE, BLOCK_BYTES = 10, 0.08, 1 << 22
#: Positions of a text whose q-grams are looked up at once, and hits that are counted at once.
SLICE, HITS = 1 << 18, 1 << 20
_BITS = 22
_K1, _K2 = C.U64(0x9E3779B97F4A7C15), C.U64(0xC2B2AE3D27D4EB4F)


def normalize(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and which bytes were kept."""
    space = C.IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = C.ASCII_LOWER[data]
    out[space] = 32
    return out[keep], keep


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the Q bytes from each position."""
    if len(data) < Q:
        return np.zeros(0, C.U64)
    x = data.astype(C.U64)
    x2 = x[:-1] | x[1:] << C.U64(8)
    x4 = x2[:-2] | x2[2:] << C.U64(16)
    x8 = x4[:-4] | x4[4:] << C.U64(32)
    with np.errstate(over="ignore"):
        return x8[: len(data) - Q + 1] * _K1 + x2[8:][: len(data) - Q + 1] * _K2


class Index:
    """Sorted q-grams of a block of items with their postings."""

    def __init__(self, items: list[tuple], rate: float):
        self.ids = [i for i, _ in items]
        self.text = [normalize(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip(b" ") for _, t in items]
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.budget = np.maximum(0, np.minimum((rate * self.length).astype(np.int64), (self.length - Q) // Q))
        self.need = self.length - Q + 1 - Q * self.budget
        self.short = [i for i, t in enumerate(self.text) if 0 < len(t) < Q]
        parts = [grams(np.frombuffer(t, np.uint8)) for t in self.text]
        keys = np.concatenate(parts) if parts else np.zeros(0, C.U64)
        item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int32)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> C.U64(64 - _BITS)).astype(np.int64)

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item position) of every shared q-gram, in order of text position."""
        for low in range(0, max(0, len(data) - Q + 1) if len(self.keys) else 0, SLICE):
            keys = grams(data[low : low + SLICE + Q - 1])
            at = np.flatnonzero(self.maybe[self._slot(keys)])
            k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            found = self.keys[k] == keys[at]
            at, k = at[found] + low, k[found]
            many = (self.first[k + 1] - self.first[k]).astype(np.int64)
            upto = np.cumsum(many)
            a = 0
            while a < len(at):  # a q-gram of many items comes in pieces
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
                n = many[a:z]
                post = np.repeat(self.first[k[a:z]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield np.repeat(at[a:z], n), self.item[post].astype(np.int64), self.place[post].astype(np.int64)
                a = z


def align(item: bytes, region: bytes, low: int, high: int, budget: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of ``item`` in ``region`` on diagonals low..high (start - item position).

    The least cost of a row never falls again, so a row beyond ``budget`` ends the alignment.
    """
    width = high - low + 1
    text = np.frombuffer(region, np.uint8)
    diag = np.arange(low, high + 1)
    big = len(item) + len(region) + 1
    cost = np.where((diag >= 0) & (diag <= len(text)), 0, big)
    start = diag.copy()
    lane = np.arange(width)
    edge = max(0, -low)
    padded = np.zeros(edge + max(len(text), high + len(item) + 1), np.int16)
    padded[edge : edge + len(text)] = text
    skip, after = np.full(width, big), np.zeros(width, start.dtype)
    for i, ch in enumerate(item):
        j = diag + i  # the text byte taken by a match or substitution
        sub = cost + (padded[low + i + edge : low + i + edge + width] != ch)
        sub[(j < 0) | (j >= len(text))] = big
        skip[:-1] = cost[1:] + 1  # the item byte has no partner: the diagonal falls by one
        new = np.minimum(sub, skip)
        after[:-1] = start[1:]
        origin = np.where(sub <= skip, start, after)
        new[(j < -1) | (j >= len(text))] = big
        shifted = new - lane  # extra text bytes: the diagonal rises by one
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, lane, 0))
        cost, start = best + lane, origin[source]
        cost[j >= len(text)] = big
        if cost.min() > budget:
            return big, 0, 0
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(diag[k] + len(item))


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(keys)).astype(np.int64)


def search(index: Index, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """For each text, (item number, edits, start, end) of the best occurrence of each item that leaks; code points."""
    flat = C.Flat(texts)
    data, kept = normalize_flat(flat)
    bounds = np.concatenate([[0], np.cumsum(kept)])[flat.off]
    source = np.flatnonzero(kept)
    raw = data.tobytes()
    out: list[dict[int, tuple]] = [{} for _ in range(flat.n)]
    # one number for (text, item, band); each hit counts in its band and in the one before
    longest = int(np.diff(bounds).max(initial=0)) + int(index.length.max(initial=0))
    least, span_ = -longest - 1, 2 * longest + 3
    counts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, item, place in index.hits(data):
        doc = np.searchsorted(bounds, at, "right") - 1
        whole = at + Q <= bounds[doc + 1]
        at, item, place, doc = at[whole], item[whole], place[whole], doc[whole]
        band = (at - bounds[doc] - place) // (index.budget[item] + 1)
        key = (doc * len(index.ids) + item) * span_ + band - least
        counts.append(np.unique(np.concatenate([key, key - 1]), return_counts=True))
        if sum(len(k) for k, _ in counts) > 2 * HITS:
            counts = [summed(counts)]
    key, count = summed(counts)
    if len(key):
        pair = key // span_
        full = count >= index.need[pair % len(index.ids)]
        for k in np.flatnonzero(full)[np.argsort(-count[full], kind="stable")].tolist():
            d, i, b = int(pair[k]) // len(index.ids), int(pair[k]) % len(index.ids), int(key[k]) % span_ + least
            if i in out[d] and not out[d][i][0]:
                continue
            e, m = int(index.budget[i]), int(index.length[i])
            low, high = b * (e + 1) - e, (b + 2) * (e + 1) - 1 + e
            begin, stop = max(0, low), min(int(bounds[d + 1] - bounds[d]), high + m)
            region = raw[bounds[d] + begin : bounds[d] + stop]
            exact = region.find(index.text[i])
            edits, s, t = (0, exact, exact + m) if exact >= 0 else align(index.text[i], region, low - begin, high - begin, e)
            if edits <= e and (i not in out[d] or out[d][i][0] > edits):
                out[d][i] = (edits, begin + s, begin + t)
    for i in index.short:
        for d in range(flat.n):
            if (s := raw[bounds[d] : bounds[d + 1]].find(index.text[i])) >= 0:
                out[d][i] = (0, s, s + len(index.text[i]))
    points = np.concatenate([[0], np.cumsum((flat.data & 0xC0) != 0x80)])

    def span(d: int, s: int, t: int) -> tuple[int, int]:
        a, z = source[bounds[d] + s], source[bounds[d] + max(s, t - 1)]
        return int(points[a] - points[flat.off[d]]), int(points[z + 1] - points[flat.off[d]])

    return [[(i, edits, *span(d, s, t)) for i, (edits, s, t) in sorted(found.items())] for d, found in enumerate(out)]


def normalize_flat(flat: C.Flat) -> tuple[np.ndarray, np.ndarray]:
    """As normalize, but the first byte of each text is kept."""
    data = flat.data
    space = C.IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[flat.off[:-1][flat.off[:-1] < len(data)]] = True
    out = C.ASCII_LOWER[data]
    out[space] = 32
    return out[keep], keep


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (struct of ``keep``) and ``leaks``: array of (item_id, edits, start, end), empty for clean rows."""
    spark, keep = df.sparkSession, keep or df.columns
    number = dict(benchmark.dtypes)[item_id] in ("tinyint", "smallint", "int", "bigint")
    items = benchmark.select(F.col(f"`{item_id}`").cast("bigint" if number else "string").alias("id"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    kind = f"array<struct<item_id:{'bigint' if number else 'string'},edits:bigint,`start`:bigint,`end`:bigint>>"
    made = pa.list_(pa.struct([("item_id", pa.int64() if number else pa.string()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    out, inner = df, keep if blocks == 1 else list(dict.fromkeys([*keep, text]))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).orderBy("id", "t")
        index = spark.sparkContext.broadcast(Index([(r.id, r.t) for r in part.toLocalIterator()], rate))

        def run(_, texts, *before):
            ids = index.value.ids
            new = [[{"item_id": ids[i], "edits": e, "start": s, "end": t} for i, e, s, t in found] for found in search(index.value, texts)]
            if before:
                new = [a + b for a, b in zip(before[0].to_pylist(), new)]
            return {"leaks": pa.array(new, made)}

        if block == 0:
            out = C.map_texts(out, text, inner, run, [("leaks", kind)])
        else:
            out = C.map_texts(C.materialize(out, "leaks"), F.col(f"row.`{text}`"), ["row"], run, [("leaks", kind)], ["leaks"]).select("row.row", "leaks")
    return out.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "leaks") if blocks > 1 else out
