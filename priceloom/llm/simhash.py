"""Operator 6: near-dedup of SimHash fingerprints with pivot distance tables.

``PIVOTS`` reference fingerprints are fixed, and a table holds the Hamming distance of each distinct
fingerprint to every one of them.  Fingerprints at ``max_bits`` or fewer differing bits differ by ``max_bits`` at
most in each of these distances, so pairs with a larger coordinate difference are discarded, and the
survivors are verified by their exact distance.

The table discards pairs but can't deal them to tasks: around random references most fingerprints lie within a
few bits of one another.  So bytes bring pairs together: at most ``max_bits`` differing bits leave 8 -
``max_bits`` of the eight bytes untouched, and a fingerprint is dealt once for each choice of that many bytes
(28 for two bits).  Within a bucket, rows are swept in order of the distance to the first reference, so the
table's first coordinate bounds which pairs are formed at all; the others thin them out (the README has the
counts).  A bucket leaves ``8 * max_bits`` bits free, so it holds 65,536 different fingerprints at most.  Of the
links of a bucket only a spanning forest is emitted: no link between components is lost.

Copies share one fingerprint and are folded before any comparison.  Null and empty texts have fingerprint zero
and link like any other.  Very long texts are hashed whole, 32,768 shingles at a time.  Ties: a component is
named by its least id, whatever the order.  Repeated rows and rows with null ids get a row each; a null id
never names a component that has another id.  An empty table gives an empty table.  Only the id and the
text are read, so extra columns can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SEED, PIVOTS = 42, 16


def fingerprint(raw: bytes, width: int) -> int:
    """The SimHash of the ``width``-word shingles of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return hash64(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.fromiter((hash64(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(_, texts):
        flat = C.Flat(texts)
        raw, off = flat.data.tobytes(), flat.off.tolist()
        return {"fp": np.fromiter((fingerprint(raw[a:b], width) for a, b in zip(off, off[1:])), np.uint64, flat.n).view(np.int64)}

    return C.map_texts(df, text, [doc_id], run, [("fp", "bigint")]).select(F.col(f"row.`{doc_id}`").alias("id"), "fp")


class PivotTable:
    """Distances to the reference fingerprints."""

    def __init__(self, pivots: int = PIVOTS):
        self.refs = C.mix(np.arange(1, pivots + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))

    def total(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.refs[None, :])


def keys(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """A column for each choice of 8 - ``max_bits`` bytes: fingerprints that agree in them share its key."""
    out = []
    for n, alike in enumerate(combinations(range(8), 8 - max_bits)):
        with np.errstate(over="ignore"):
            out.append(C.mix(C.mix(fp & C.U64(sum(0xFF << 8 * k for k in alike))) + C.U64(n)))
    return np.stack(out, 1)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): a spanning forest of the links between different fingerprints of each bucket."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(C.U64)
            dealt = keys(fp, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(dealt.ravel().view(np.int64)), pa.array(np.repeat(fp, dealt.shape[1]).view(np.int64))], names=["key", "fp"])

    def sweep(batches):
        table = PivotTable()
        left = np.zeros((0, 2), np.int64)
        for batch in batches:
            rows = np.concatenate([left, np.stack([c.to_numpy() for c in batch.columns], 1)])
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0  # the last bucket may go on
            left = rows[whole:]
            yield joined(rows[:whole], table, max_bits)
        yield joined(left, table, max_bits)

    spread_out = fps.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    return spread_out.repartition("key").sortWithinPartitions("key").mapInArrow(sweep, "a bigint, b bigint").distinct()


def joined(rows: np.ndarray, table: PivotTable, max_bits: int) -> pa.RecordBatch:
    """Each fingerprint of these buckets with the least one that it is connected to in its bucket."""
    near = np.zeros(len(rows), bool)
    if len(rows) > 1:
        same = rows[1:, 0] == rows[:-1, 0]
        near[1:] |= same
        near[:-1] |= same
    rows = rows[near]
    key, fp = rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(C.U64)
    far = table.total(fp).astype(np.int16)
    order = np.lexsort((far[:, 0], key))
    key, fp, far = key[order], fp[order], far[order]
    label = np.arange(len(fp))
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[(key[at] == key[at + step]) & (far[at + step, 0] - far[at, 0] <= max_bits)]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            i = i[np.abs(far[i] - far[i + step]).max(1) <= max_bits]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
            hook(label, i, i + step)
        step += 1
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs (a, b) in ``label`` (least member, fully followed)."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of ``max_bits`` or fewer bits."""
    docs = C.materialize(fingerprints(df, doc_id, text, width), "fingerprints")
    fps = C.materialize(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    labels = components(links(fps, max_bits))
    linked = C.materialize(labels.join(fps, labels.node == fps.fp).select("fp", "label", "first"), "linked")
    least = C.materialize(linked.groupBy("label").agg(F.min("first").alias("component")), "component-ids")
    copies = fps.where("n > 1").join(labels, fps.fp == labels.node, "left_anti").select("fp", F.col("first").alias("component"))
    of = C.materialize(linked.join(least, "label").select("fp", "component").union(copies), "components")
    return docs.join(of, "fp", "left").select("id", "fp", F.coalesce("component", "id").alias("component"))
