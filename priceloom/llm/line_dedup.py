"""Operator 4: line dedup with a once-seen and a twice-seen Bloom filter.

1. Every task hashes its line keys (XXH64) and ships the hashes, packed by filter segment, to the
   segment's owner.  The owner keeps two Bloom filters: a hash whose bits are already in the first one
   (seen once) is entered into the second one (seen at least twice) and reported.  These filters
   grow with the number of lines; each owner holds its segments only.
2. The hashes seen twice make the filter that is broadcast: ``BITS_PER_LINE`` bits for each different line
   that repeats, between ``MIN_BITS`` and ``max_bits`` (64 MB by default, enough for 32 million of them).  Past
   that it only gets fuller: more keys are suspected and shuffled, no result changes.
3. Documents without a suspected key are done with: they are never shuffled.  The others are written
   with their suspected keys; the keys are shuffled for the exact count of documents and the
   choice of the document that keeps the line, and each document is joined with its keys to drop.

A line's key: the line without surrounding white space, A-Z lower-cased.  Keys of at least
``min_points`` code points in at least ``min_docs`` documents lose their lines everywhere but in the
largest id.

Null or empty text is one empty line.  Very long texts are read whole; a task then holds some 25 bytes
for each of the text's.  Ties and repeated rows: rows with equal ids count as one document and all
keep or all lose a line; a null id never counts and never keeps, but loses confirmed lines.  An empty table
gives an empty table.  The given columns stay in ``row``, so no name can clash.  The table is read three
times and must hold the same rows each time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a filter: ``BITS_PER_LINE`` a hash; at least 1 MB; at most 64 MB for the one that is broadcast.
BITS_PER_LINE, MIN_BITS, MAX_BITS = 16, 1 << 23, 1 << 29
SEGMENT_BITS = 1 << 17
#: Hashes that a task gathers before it ships them.
FLUSH = 1 << 20
#: Keys longer than this are shuffled as their SHA-256.
KEY_BYTES = 64


class Keys:
    """The line keys of a chunk of texts."""

    def __init__(self, texts: pa.Array, min_points: int):
        self.flat = C.Flat(texts)
        data = C.ASCII_LOWER[self.flat.data]
        starts, ends, self.owner = self.flat.lines()
        words, stops, _ = self.flat.runs(~C.IS_SPACE[data])
        a, b = np.searchsorted(words, starts), np.searchsorted(words, ends)
        some = np.flatnonzero(b > a)
        ks, ke = words[a[some]], stops[b[some] - 1]
        enough = C.count_in(C.is_point(data), ks, ke) >= min_points
        #: Line numbers within the chunk whose key is long enough, and the keys.
        self.line = some[enough]
        self.keys = C.packed(data, ks[enough], ke[enough])

    def once(self, at: np.ndarray | None = None) -> np.ndarray:
        """Of the keys ``at`` (default: all), the first of each different one of a text."""
        at = np.arange(len(self.line)) if at is None else at
        number, _ = C.numbered(self.keys.take(pa.array(at)))
        first = np.unique(self.owner[self.line[at]] * (len(at) + 1) + number, return_index=True)[1]
        return at[np.sort(first)]

    def key(self, i: int) -> bytes:
        raw = self.keys[int(i)].as_py()
        return raw if len(raw) <= KEY_BYTES else b"\0" + hashlib.sha256(raw).digest()


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.U64(SEGMENT_BITS - 1)
    return (h & low).astype(np.int64), ((h >> C.U64(17)) & low).astype(np.int64)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> C.U64(64 - (segments.bit_length() - 1))).astype(np.int64)


def size_bits(lines: int, most: int | None = None) -> int:
    bits = MIN_BITS
    while bits < BITS_PER_LINE * lines and (most is None or bits < most):
        bits *= 2
    return bits


def by_segment(h: np.ndarray, n: np.ndarray, segments: int) -> pa.RecordBatch:
    """Sorted hashes packed by segment, with a bit for those met more than once."""
    cut = np.searchsorted(_segment(h, segments), np.arange(segments + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([h[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary()), pa.array([np.packbits(n[cut[s] : cut[s + 1]] > 1).tobytes() for s in full], pa.binary())], names=["segment", "hashes", "twice"])


def twice_seen(df: DataFrame, text: str, min_points: int, bits: int) -> DataFrame:
    """(hashes): the hashes whose bits were met before, each about once, as packed arrays."""
    segments = bits // SEGMENT_BITS

    def ship(batches):
        held, size = [], 0
        for batch in batches:
            for part in C.chunks(batch, "text"):
                k = Keys(part.column(0), min_points)
                held.append(C.hashes(k.keys.take(pa.array(k.once()))))
                size += len(held[-1])
                if size >= FLUSH:
                    yield by_segment(*np.unique(np.concatenate(held), return_counts=True), segments)
                    held, size = [], 0
        if size:
            yield by_segment(*np.unique(np.concatenate(held), return_counts=True), segments)

    def own(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, hashes, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if segment not in seen:
                    seen[segment] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                once, again = seen[segment]
                h = np.frombuffer(hashes, C.U64)
                p, q = _bits(h)
                hit = once[p] & once[q] | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(h)).astype(bool)
                new = hit & ~(again[p] & again[q])
                once[p] = once[q] = True
                again[p[hit]] = again[q[hit]] = True
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array([h[new].tobytes()], pa.binary())], names=["hashes"])

    C.settings(df.sparkSession)
    sent = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(ship, "segment int, hashes binary, twice binary")
    return sent.repartition("segment").mapInArrow(own, "hashes binary")


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of all ``hashes`` as packed bits, one row a segment; built by segment, collected within ``bits``."""
    segments = bits // SEGMENT_BITS

    def ship(batches):
        for batch in batches:
            h = np.unique(np.concatenate([np.frombuffer(x, C.U64) for x in batch.column(0).to_pylist()] or [np.zeros(0, C.U64)]))
            yield by_segment(h, np.ones(len(h)), segments).select(["segment", "hashes"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                p, q = _bits(np.frombuffer(hashes, C.U64))
                table = held.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
                table[p] = table[q] = True
        for segment, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in hashes.mapInArrow(ship, "segment int, hashes binary").repartition("segment").mapInArrow(fill, "segment int, bits binary").toLocalIterator():
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out


def count_lines(df: DataFrame, text: str) -> int:
    t = F.col(f"`{text}`").cast("string")
    return df.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, min_points: int = 20, min_docs: int = 3, bits: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``row`` (struct of ``keep``) with n_lines, n_dropped and ``kept_text``; ``bits``: of both filters, instead of their own sizes."""
    keep = keep or df.columns
    repeats = C.materialize(twice_seen(df, text, min_points, bits or size_bits(count_lines(df, text))), "hashes-twice")
    seen = repeats.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    again = df.sparkSession.sparkContext.broadcast(bloom(repeats, bits or size_bits(seen // 8, max_bits)))

    def suspected(texts) -> tuple[Keys, np.ndarray]:
        table, k = again.value, Keys(texts, min_points)
        h = C.hashes(k.keys)
        s, (p, q) = _segment(h, len(table)), _bits(h)
        return k, np.flatnonzero(table[s, p >> 3] >> (p & 7) & table[s, q >> 3] >> (q & 7) & 1)

    def find(rows, texts, ids, *more):
        k, maybe = suspected(texts)
        maybe = k.once(maybe)
        of = k.owner[k.line[maybe]]
        some, first = np.unique(of, return_index=True)
        off = pa.array(np.append(first, len(of)).astype(np.int32))
        keys = pa.ListArray.from_arrays(off, pa.array([k.key(i) for i in maybe], pa.binary()))
        take = pa.array(some)
        return {"__take__": some, "id": ids.take(take), "keys": keys} | ({"text": more[0].take(take)} if more else {})

    def rest(rows, texts):
        k, maybe = suspected(texts)
        free = np.setdiff1d(np.arange(len(texts)), k.owner[k.line[maybe]])
        return {"__take__": free, "n_lines": np.bincount(k.owner, minlength=len(texts))[free], "n_dropped": np.zeros(len(free), np.int64), "kept_text": texts.fill_null("").take(pa.array(free))}

    def cut(rows, texts, drops):
        n = len(texts)
        k = Keys(texts, min_points)
        owner = k.owner[k.line]
        first = np.searchsorted(k.owner, np.arange(n))
        n_dropped = np.zeros(n, np.int64)
        out = texts.fill_null("").to_pylist()
        for i in np.flatnonzero(np.asarray(drops.is_valid())):
            gone = set(drops[int(i)].as_py())
            a, b = np.searchsorted(owner, [i, i + 1])
            at = {int(k.line[x] - first[i]) for x in range(a, b) if k.key(x) in gone}
            out[i] = "\n".join(line for y, line in enumerate(out[i].split("\n")) if y not in at)
            n_dropped[i] = len(at)
        return {"n_lines": np.bincount(k.owner, minlength=n), "n_dropped": n_dropped, "kept_text": pa.array(out, pa.string())}

    fields = [("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_text", "string")]
    own = [] if text in keep and dict(df.dtypes)[text] == "string" else [("text", "string")]  # else row holds the text already
    found = C.map_texts(df, text, keep, find, [("id", dict(df.dtypes)[doc_id]), ("keys", "array<binary>"), *own], [F.col(f"`{doc_id}`"), *[F.col(f"`{text}`").cast("string") for _ in own]])
    found = C.materialize(found.withColumn("number", F.monotonically_increasing_id()), "lines-suspected")
    lines = found.select("number", "id", F.explode("keys").alias("line"))
    held = lines.groupBy("line").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    held = C.materialize(held.select("line", "keeper"), "lines-confirmed")
    drop = lines.join(held, "line").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("number").agg(F.collect_set("line").alias("drop"))
    both = found.drop("id", "keys").join(drop, "number", "left")
    done = C.map_texts(both, F.col("text") if own else F.col(f"row.`{text}`"), ["row"], cut, fields, ["drop"]).select("row.row", *[n for n, _ in fields])
    return C.map_texts(df, text, keep, rest, fields).union(done)
