"""Operator 3: language-model scoring by context-tree weighting, beside a unigram base score.

The tree's contexts are the last 0 to ``DEPTH`` bytes (texts with A-Z lower-cased; 0xFF, which UTF-8 never
uses, pads the start and ends the text).  Each context codes the next byte as eight binary
decisions with Krichevsky-Trofimov estimates, and every context of the training texts is kept.

1. The grams (``DEPTH`` bytes and the next one) of all texts are counted inside the tasks and summed by grouped
   aggregation: how often in training texts, and how often in all.
2. A gram's code length needs nothing but the counts of the contexts on its path.  The grams are
   dealt by the last ``SPLIT`` bytes of their context, which keeps each subtree in one task (at most 2**24 grams); the tasks
   weigh their subtrees from the leaves up.  The two levels above have 257 contexts and are weighed in the
   driver.  Then each task writes the logarithm of every gram's probability.
3. The ``HOT`` grams that are met most often in all texts are broadcast, a fixed bound; the others are looked
   up by a join of (row, gram, times).  None of those is met more often than any of the broadcast
   ones, so no join key is hot.  What is learned grows with the corpus; nothing is left out.

``LEAST_SHARE`` is off (0): if set, contexts with less than that share of all positions lose their own counts, and
the children of a context that are not kept share one rest child.

Base score: words ``[^\\x20\\x09-\\x0D]+`` and one end a text, looked up in the same two ways.

Null text is empty: one end.  Very long texts are coded in slices; nothing is cut off.  Without training rows the tree is
its root, one bit a decision.  Ties need no choice: equal counts are all broadcast or none.  Rows get a key of
their own: repeated rows and null ids get a row each.  An empty table gives an empty table.  The given
columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH, SPLIT, LEAST_SHARE, HOT, END = 4, 2, 0.0, 1 << 20, 0xFF
#: Positions that are coded at once, and grams that are weighed at once (more where one suffix has more).
SLICE, BLOCK = 1 << 18, 1 << 16


# ---------------------------------------------------------------- counting


def positions(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context and next byte as one number, text number) of every coded byte, the end included, in slices."""
    flat = C.Flat(texts)
    line = np.full(len(flat.data) + DEPTH * (flat.n + 1), END, np.uint8)
    for i, (a, z) in enumerate(zip(flat.off.tolist(), flat.off[1:].tolist())):
        line[a + DEPTH * (i + 1) : z + DEPTH * (i + 1)] = C.ASCII_LOWER[flat.data[a:z]]
    first = flat.off + np.arange(flat.n + 1)
    for low in range(0, int(first[-1]), SLICE):
        high = min(low + SLICE, int(first[-1]))
        owner = np.repeat(np.arange(flat.n), np.diff(np.clip(first, low, high)))
        at = np.arange(low, high) + (DEPTH - 1) * owner
        part = line[at[0] : at[-1] + DEPTH + 1]
        gram = np.zeros(len(part) - DEPTH, np.uint64)
        for k in range(DEPTH + 1):
            gram |= part[k : k + len(gram)].astype(np.uint64) << np.uint64(8 * (DEPTH - k))
        yield gram[at - at[0]], owner


def counted(df: DataFrame, text: str, learn: Column | None) -> DataFrame:
    learned = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    C.settings(df.sparkSession)
    return df.select(F.col(f"`{text}`").cast("string").alias("text"), learned.alias("learn"))


def count_grams(df: DataFrame, text: str, learn: Column | None = None) -> DataFrame:
    """(gram, n, seen): contexts of full depth with their next byte; n counts the learned texts, seen all."""

    def merged(parts):
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64) for k in (1, 2))

    def batch_of(keys, n, seen):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(seen)], names=["gram", "n", "seen"])

    def run(batches):
        held: list = []
        for batch in batches:
            for part in C.chunks(batch, "text"):
                learned = part.column(1).to_numpy(zero_copy_only=False)
                for gram, owner in positions(part.column(0)):
                    for which in (True, False):
                        keys, n = np.unique(gram[learned[owner] == which], return_counts=True)
                        held.append((keys, n if which else np.zeros_like(n), n))
                    if sum(len(p[0]) for p in held) > 1 << 21:
                        held = [merged(held)]
                        if len(held[0][0]) > 1 << 20:
                            yield batch_of(*held[0])
                            held = []
        if held:
            yield batch_of(*merged(held))

    return counted(df, text, learn).mapInArrow(run, "gram bigint, n bigint, seen bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def count_words(df: DataFrame, text: str, learn: Column | None = None) -> DataFrame:
    """(word, n, seen): n counts the learned texts, seen all."""

    def run(batches):
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def packed():
            for learned, words in held.items():
                n = pa.array(list(words.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string()), n if learned else pa.array(np.zeros(len(n), np.int64)), n], names=["word", "n", "seen"])
                words.clear()

        for batch in batches:
            for part in C.chunks(batch, "text"):
                learned = part.column(1)
                for which, words in held.items():
                    # texts never join to one word: a line feed stands between them
                    words.update("\n".join(part.column(0).filter(learned if which else pa.compute.invert(learned)).fill_null("").to_pylist()).encode().lower().split())
                if sum(map(len, held.values())) > 1 << 20:
                    yield from packed()
        yield from packed()

    return counted(df, text, learn).mapInArrow(run, "word string, n bigint, seen bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


# ---------------------------------------------------------------- the weighted tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function (Stirling's series after eight steps of recurrence)."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def kt(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a one, logarithm of the block probability)."""
    block = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)
    return (ones + 0.5) / (zeros + ones + 1), block


def mixture(zeros, ones, kept_zeros, kept_ones, product, split) -> tuple[np.ndarray, ...]:
    """Weigh nodes against their kept children: (own estimate, its weight, rest child's estimate, log P_w).

    ``kept_zeros``, ``kept_ones`` and ``product`` are sums over the kept children; ``split``: there are any.
    """
    one, block = kt(zeros, ones)
    rest, rest_block = kt(np.maximum(zeros - kept_zeros, 0), np.maximum(ones - kept_ones, 0))
    below = product + rest_block
    share = np.where(split, 1 / (1 + np.exp(np.clip(below - block, -700, 700))), 1.0)
    return one, share, rest, np.where(split, np.logaddexp(block, below) - np.log(2), block)


class Subtrees:
    """The levels ``DEPTH`` to ``SPLIT`` over the grams of some suffixes; the arrays hold a row for each (context, node) met."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, least: float):
        byte = (gram & C.U64(255)).astype(np.int64)[:, None]
        level = np.arange(8)
        self.node = byte >> (8 - level) | 1 << level
        self.bit = byte >> (7 - level) & 1
        self.context = gram >> C.U64(8)
        times = np.repeat(n, 8).astype(float)
        self.levels: list[tuple] = []
        below = None
        for d in range(DEPTH, SPLIT - 1, -1):
            ctx = self.context & C.U64((1 << 8 * d) - 1)
            keys, row = np.unique((ctx[:, None] << C.U64(8) | self.node.astype(C.U64)).ravel(), return_inverse=True)
            row = row.ravel()
            ones = np.bincount(row, weights=times * self.bit.ravel(), minlength=len(keys))
            zeros = np.bincount(row, weights=times, minlength=len(keys)) - ones
            whole = (zeros + ones)[row[::8]]  # of each gram's context
            kept = (whole > 0) & (whole >= least)
            if below is None:
                one, block = kt(zeros, ones)
                made = one, np.ones(len(keys)), one, block
            else:
                sums, split = self.of_children(below, row, len(keys))
                context_split = np.zeros(len(keys), bool)
                context_split[row] = np.repeat(split[row[::8]], 8)
                made = mixture(zeros, ones, *sums, context_split)
            below = (row, kept, zeros, ones, made[3], len(keys))
            self.levels.append((row, kept, *made[:3]))
        self.below, self.keys = below, keys

    def of_children(self, below: tuple, row: np.ndarray, n: int) -> tuple[tuple, np.ndarray]:
        """Over the kept children of each of ``n`` rows: sums of zeros, ones and log P_w; and whether there are any."""
        child, kept, zeros, ones, weighted, n_children = below
        parent, is_kept = np.zeros(n_children, np.int64), np.zeros(n_children, bool)
        parent[child], is_kept[child] = row, np.repeat(kept, 8)
        up = parent[is_kept]
        split = np.zeros(n, bool)
        split[up] = True
        return tuple(np.bincount(up, weights=x[is_kept], minlength=n) for x in (zeros, ones, weighted)), split

    def for_top(self) -> tuple[np.ndarray, ...]:
        """Parents' keys of level ``SPLIT`` with zeros and ones of all children; the same and log P_w of the kept ones."""
        low = C.U64((1 << 8 * SPLIT) - 1)
        _, kept, zeros, ones, weighted, n = self.below
        is_kept = np.zeros(n, bool)
        is_kept[self.below[0]] = np.repeat(kept, 8)
        keys, up = np.unique(self.keys & low, return_inverse=True)
        sums = [np.bincount(up.ravel(), weights=x * w, minlength=len(keys)) for x, w in ((zeros, 1), (ones, 1), (zeros, is_kept), (ones, is_kept), (weighted, is_kept), (is_kept, 1))]
        return keys, *sums

    def log10(self, top: list[tuple]) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        p, inside = None, None
        for row, kept, one, share, rest in self.levels:
            q = one[row] if p is None else np.where(np.repeat(inside, 8), p, rest[row])
            p, inside = share[row] * one[row] + (1 - share[row]) * q, kept
        p = p.reshape(-1, 8)
        for kept, one, share, rest in top:  # levels SPLIT - 1 to 0, dense by context and node
            ctx = (self.context & C.U64(len(one) - 1)).astype(np.int64)[:, None]
            own, weight = one[ctx, self.node], share[ctx, self.node]
            p = weight * own + (1 - weight) * np.where(inside[:, None], p, rest[ctx, self.node])
            inside = kept[ctx[:, 0]]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).sum(1)


def weigh_top(keys: np.ndarray, sums: list[np.ndarray], least: float) -> list[tuple]:
    """The levels ``SPLIT`` - 1 to 0 from the sums of the subtrees: (kept, own estimate, weight, rest estimate)."""
    size = 1 << 8 * (SPLIT - 1)
    zeros, ones, kept_zeros, kept_ones, product, kids = (np.bincount(keys.astype(np.int64), weights=x, minlength=size * 256).reshape(size, 256) for x in sums)
    out = []
    while True:
        one, share, rest, weighted = mixture(zeros, ones, kept_zeros, kept_ones, product, np.broadcast_to(kids[:, 1:2] > 0, zeros.shape))
        whole = zeros[:, 1] + ones[:, 1]
        kept = (whole > 0) & (whole >= least)
        out.append((kept, one, share, rest))
        if size == 1:
            return out
        size //= 256
        up = lambda x: x.reshape(256, size, 256).sum(0)  # noqa: E731, B023  the byte further back is the higher one
        mask = np.broadcast_to(kept[:, None], zeros.shape)
        zeros, ones, kept_zeros, kept_ones, product, kids = up(zeros), up(ones), up(zeros * mask), up(ones * mask), up(weighted * mask), up(mask.astype(float))


def by_suffix(grams: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(gram, n, seen)`` to blocks that hold every gram of their suffixes (``SPLIT`` bytes of context)."""

    def run(batches):
        left = np.zeros((4, 0), np.int64)
        for batch in batches:
            left = np.concatenate([left, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            whole = int(np.searchsorted(left[0], left[0, -1])) if left.shape[1] else 0  # the last suffix may go on
            if whole >= BLOCK:
                yield fn(np.ascontiguousarray(left[1, :whole]).view(C.U64), *left[2:, :whole])
                left = left[:, whole:]
        if left.shape[1]:
            yield fn(np.ascontiguousarray(left[1]).view(C.U64), *left[2:])

    suffix = F.shiftright("gram", 8).bitwiseAND((1 << 8 * SPLIT) - 1)
    return grams.select(suffix.alias("suffix"), "gram", "n", "seen").repartition("suffix").sortWithinPartitions("suffix").mapInArrow(run, schema)


def code(grams: DataFrame) -> DataFrame:
    """(gram, seen, log10): of a table (gram, n, seen), each gram's logarithm under the tree of the counts n."""
    least = LEAST_SHARE * (grams.agg(F.sum("n")).first()[0] or 0)
    names = ["zeros", "ones", "kept_zeros", "kept_ones", "product", "kids"]

    def climb(gram, n, _):
        keys, *sums = Subtrees(gram, n, least).for_top()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["key", *names])

    tops = by_suffix(grams, climb, "key bigint, " + ", ".join(f"{x} double" for x in names))
    rows = tops.groupBy("key").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # 65,536 at most
    top = weigh_top(rows.column("key").to_numpy(), [rows.column(x).to_numpy() for x in names], least)

    def logs(gram, n, seen):
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(seen), pa.array(Subtrees(gram, n, least).log10(top))], names=["gram", "seen", "log10"])

    return by_suffix(grams, logs, "gram bigint, seen bigint, log10 double")


class Tree:
    """``tables``: one, with log10 of all 256 bytes in each context of full depth."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        contexts = np.unique(gram >> C.U64(8))
        asked = (contexts[:, None] << C.U64(8) | np.arange(256, dtype=C.U64)).ravel()
        times = np.zeros(len(asked), np.int64)
        times[np.searchsorted(asked, gram)] = n
        tree = Subtrees(asked, times, 0.0)
        keys, *sums = tree.for_top()
        self.tables = [C.Lookup(C.mix(contexts), tree.log10(weigh_top(keys, sums, 0.0)).reshape(-1, 256))]


def fit(grams: DataFrame) -> Tree:
    """The predictions of a small table (gram, n) in the driver's memory, to look into a model; scoring doesn't use it."""
    rows = grams.select("gram", "n").orderBy("gram").toArrow()
    return Tree(rows.column("gram").to_numpy().view(C.U64), rows.column("n").to_numpy())


# ---------------------------------------------------------------- scoring


def listed(owner: np.ndarray, values: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists by text of the different values and of how often each is met."""
    code, different = C.numbered(values)
    key, times = np.unique(owner * (len(different) + 1) + code, return_counts=True)
    off = pa.array(np.searchsorted(key, np.arange(n + 1) * (len(different) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(off, different.take(pa.array(key % (len(different) + 1)))), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int64)))


def score(df: DataFrame, learn: Column, text: str = "text", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """``row`` (struct of ``keep``) with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    sc = df.sparkSession.sparkContext
    n_train = df.where(F.coalesce(learn, F.lit(False))).count()
    words = C.materialize(count_words(df, text, learn), "lm-words")
    grams = C.materialize(count_grams(df, text, learn), "lm-grams")
    coded = C.materialize(code(grams), "lm-codes")
    total = words.where("n > 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total.n or 0) + n_train, total.v + (1 if n_train else 0)

    rows = words.where(F.col("seen") >= C.least_count(words, hot, "seen")).toArrow()
    times = rows.column("n").to_numpy()
    hot_words = rows.column("word").cast(pa.large_binary()).combine_chunks()
    word_hashes = np.concatenate([np.zeros(0, C.U64), *(C.hash_each(b.column(0)) for b in rows.to_batches(max_chunksize=1 << 16))])
    known = sc.broadcast((C.Lookup(word_hashes, np.arange(len(times))), hot_words, np.stack([np.log10(times + 1.0), times > 0], 1)))
    rows = coded.where(F.col("seen") >= C.least_count(coded, hot, "seen")).toArrow()
    codes = sc.broadcast(C.Lookup(C.mix(rows.column("gram").to_numpy().view(C.U64)), rows.column("log10").to_numpy().astype(np.float32)))
    del rows

    def run(_, texts):
        n, logs, far = len(texts), np.zeros(len(texts)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for gram, owner in positions(texts):
            at = codes.value.find(C.mix(gram))
            hit = at >= 0
            logs += np.bincount(owner[hit], weights=codes.value.values[at[hit]], minlength=n)
            far.append((owner[~hit], gram[~hit].view(np.int64)))
        grams = listed(np.concatenate([x for x, _ in far]), pa.array(np.concatenate([x for _, x in far])), n)
        flat = C.Flat(texts)
        data = C.ASCII_LOWER[flat.data]
        starts, ends, of = flat.runs(~C.IS_SPACE[data])
        held = C.packed(data, starts, ends)
        table, hot_words, values = known.value
        number, different = C.numbered(held)
        at = C.confirmed(table, hot_words, different)[number]
        hit = at >= 0
        rest = listed(of[~hit], held.filter(pa.array(~hit)).cast(pa.large_string()), n)
        value = values[at[hit]].reshape(-1, 2)
        return {
            "words": C.sums_by(of, n), "hits": C.sums_by(of[hit], n, value[:, 1]), "sum": np.bincount(of[hit], weights=value[:, 0], minlength=n).astype(float),
            "logs": logs, "bytes": np.diff(flat.off), "rest": rest[0].cast(pa.list_(pa.string())), "rest_times": rest[1], "grams": grams[0], "grams_times": grams[1],
        }

    fields = [("words", "bigint"), ("hits", "bigint"), ("sum", "double"), ("logs", "double"), ("bytes", "bigint"), ("rest", "array<string>"), ("rest_times", "array<bigint>"), ("grams", "array<bigint>"), ("grams_times", "array<bigint>")]
    part = C.materialize(C.map_texts(df, text, keep or df.columns, run, fields).withColumn("key", F.monotonically_increasing_id()), "lm-scored")

    def others(name: str, value: str) -> DataFrame:
        return part.where(F.size(name) > 0).select("key", F.explode(F.arrays_zip(F.col(name).alias("x"), F.col(f"{name}_times").alias("k"))).alias("e")).select("key", F.col("e.x").alias(value), F.col("e.k").alias("k"))

    more = others("rest", "word").join(words, "word").groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_sum"))
    deep = others("grams", "gram").join(coded, "gram").groupBy("key").agg(F.sum(F.col("k") * F.col("log10")).alias("more_logs"))
    end, norm = float(np.log10(n_train + 1.0)), float(np.log10(n + v + 1.0))
    n_tokens, logs = F.col("words") + 1, F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    both = part.drop("rest", "rest_times", "grams", "grams_times").join(more, "key", "left").join(deep, "key", "left")
    return both.select(
        "row",
        n_tokens.alias("n_tokens"),
        (F.col("hits") + F.coalesce("more", F.lit(0)) + (1 if n_train else 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more_sum", F.lit(0.0)) + end - n_tokens * norm).alias("base_score"),
        logs.alias("score"),
        (-logs * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
