"""Operator 9: language identification with interpolated Kneser-Ney character models.

Texts are read as lower-cased letters (UTF-16 units of the basic plane; all letters beyond it are one
symbol), everything else as one space.  Training counts the ``ORDER``-grams of every training text of
each language inside the tasks and sums them by grouped aggregation; lower orders use continuation
counts of the full tables.  N-grams below ``LEAST_SHARE`` of their language's total are left to the lower
order, so a table holds at most 1 / ``LEAST_SHARE`` entries an order and language at any corpus size: that
bounds what is broadcast.  The mass of such n-grams goes to the back-off weight of their context.  ``least_share=0``
keeps every n-gram (the exact model, whose arrays grow with the corpus); the README states what the share costs.

A model is a set of sorted hash arrays; the interpolated log-probabilities of all languages lie
side by side, so one look-up scores a known n-gram for every language.  The language of the lowest
cross-entropy per symbol wins (ties: the first in order).  ``score`` is its softmax share with a
temperature; ``rejected`` tells that the cross-entropy is above the ``REJECT`` quantile of all that
language's own training texts predicted as it (ranks within 1 / ``ACCURACY`` of their number).  Each text is scored
once into a written table, which the quantiles are aggregated from.

Null or empty text, or text without a letter: ``und``, score 0.  Null languages are not learned from; without
any language every text is ``und``.  Very long texts are scored whole, in slices.  Repeated rows are learned from and
judged each.  An empty table gives an empty table.  The given columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, LEAST_SHARE, REJECT, ACCURACY, TEMPERATURE = 4, 1e-5, 0.999, 100_000, 10.0
SPACE, ASTRAL = 32, 0xFFFF
#: Characters that are handled at once.
SLICE = 1 << 18
_SYMBOL: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """The symbol of each code point of the basic plane: lower-case letter or space."""
    if not _SYMBOL:
        table = np.full(1 << 16, SPACE, np.uint16)
        for c in range(1 << 16):
            if (ch := chr(c)).isalpha():
                low = ord(ch.lower()[0])
                table[c] = low if low < 1 << 16 else ASTRAL
        _SYMBOL.append(table)
    return _SYMBOL[0]


def read(text: str) -> np.ndarray:
    """The symbols of a text: of a run of spaces the first stays, but none at the ends."""
    out = []
    for low in range(0, len(text), SLICE):
        points = np.frombuffer(text[low : low + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = symbols()[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            sym[i] = ASTRAL if chr(points[i]).isalpha() else SPACE
        out.append(sym)
    sym = np.concatenate(out) if out else np.zeros(0, np.uint16)
    letter = sym != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    sym = sym[keep]
    return sym[:-1] if len(sym) and sym[-1] == SPACE else sym


def grams(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, text number) of every symbol of the texts and of the space that follows each, in slices."""
    size = np.array([len(t) for t in texts], np.int64)
    line = np.full(int(size.sum()) + (ORDER - 1) * (len(texts) + 1), SPACE, np.uint16)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    for i, t in enumerate(texts):
        a = int(first[i]) - i + (ORDER - 1) * (i + 1)
        line[a : a + len(t)] = t
    for low in range(0, int(first[-1]), SLICE):
        high = min(low + SLICE, int(first[-1]))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.clip(first, low, high)))
        at = np.arange(low, high) + (ORDER - 2) * owner
        part = line[at[0] : at[-1] + ORDER]
        gram = np.zeros(len(part) - ORDER + 1, np.uint64)
        for k in range(ORDER):
            gram |= part[k : k + len(gram)].astype(np.uint64) << np.uint64(16 * (ORDER - 1 - k))
        yield gram[at - at[0]], owner


def count_grams(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) of all training texts."""

    def run(batches):
        held: dict[str, list] = {}

        def merged(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for part in C.chunks(batch, "text"):
                langs = part.column(1).to_pylist()
                code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                lang_of = np.array([code[x] for x in langs])
                for gram, owner in grams([read(t) for t in part.column(0).fill_null("").to_pylist()]):
                    which = lang_of[owner]
                    for x, i in code.items():
                        held.setdefault(x, []).append(np.unique(gram[which == i], return_counts=True))
                        if sum(len(k) for k, _ in held[x]) > 1 << 21:
                            held[x] = [merged(held[x])]
        for x, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = train.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated log2 probabilities: ``full[k]`` by k-gram, ``back[k]`` weights by context of k - 1 symbols."""

    def __init__(self, langs: list[str], orders: list[tuple]):
        self.langs, self.full, self.back = langs, {}, {}
        n_langs = len(langs)
        self.floor = np.full(n_langs, -17.0)
        for k, (lang, gram, n, total, discount) in enumerate(orders, 1):
            share = np.maximum(n - discount[lang], 0) / total
            keys, at = np.unique(gram, return_inverse=True)
            direct = np.zeros((len(keys), n_langs))
            direct[at, lang] = share
            ctx, of = np.unique(keys >> C.U64(16), return_inverse=True)
            weight = np.ones((len(ctx), n_langs))
            np.subtract.at(weight, of, direct)
            weight = np.maximum(weight, 1e-9)
            lower = self.lower(k, keys)
            self.full[k] = C.Lookup(C.mix(keys), np.log2(direct + weight[of] * np.exp2(lower)).astype(np.float32))
            self.back[k] = C.Lookup(C.mix(ctx), np.log2(weight).astype(np.float32))
            if k == 1:
                self.floor = np.log2(weight[0]) - 17.0 if len(weight) else self.floor

    def lower(self, k: int, keys: np.ndarray) -> np.ndarray:
        """log2 P of the last symbol by the orders below k."""
        if k == 1:
            return np.full((len(keys), len(self.langs)), -17.0)
        return self.log2p(k - 1, keys & C.U64((1 << 16 * (k - 1)) - 1))

    def log2p(self, k: int, keys: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs)))
        at = self.full[k].find(C.mix(keys))
        out = self.full[k].values[at] if len(self.full[k].h) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if k == 1:
                out[miss] = self.floor
            else:
                rest = self.log2p(k - 1, keys[miss] & C.U64((1 << 16 * (k - 1)) - 1))
                b = self.back[k].find(C.mix(keys[miss] >> C.U64(16)))
                out[miss] = rest + np.where((b >= 0)[:, None], self.back[k].values[b], 0) if len(self.back[k].h) else rest
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol for each text and language; which texts have a letter."""
        symbols_of = [read(t) for t in texts.fill_null("").to_pylist()]
        out = np.zeros((len(texts), len(self.langs)))
        for gram, owner in grams(symbols_of):
            bits = self.log2p(ORDER, gram)
            for x in range(len(self.langs)):
                out[:, x] -= np.bincount(owner, weights=bits[:, x], minlength=len(texts))
        # every text has at least the closing space
        return out / np.array([len(t) + 1 for t in symbols_of]).reshape(-1, 1), np.array([len(t) > 0 for t in symbols_of], bool)


def train(df: DataFrame, text: str, lang: str, least_share: float | None = None) -> Model:
    """Fit the models on every row of ``df``; ``least_share`` instead of ``LEAST_SHARE``, 0 to leave nothing to lower orders."""
    least_share = LEAST_SHARE if least_share is None else least_share
    tables = [C.materialize(count_grams(df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()), text, lang), f"grams-{ORDER}")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        tables.insert(0, C.materialize(tables[0].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}"))
    sums = [t.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")) for t in tables]
    stats = [{r.lang: r for r in s.collect()} for s in sums]  # a row a language
    langs = sorted(stats[-1])
    code = {x: i for i, x in enumerate(langs)}
    orders = []
    for k, t in enumerate(tables):
        ctx = F.shiftrightunsigned("gram", 16)
        totals = t.groupBy("lang", ctx.alias("ctx")).agg(F.sum("n").alias("c"))
        kept = t.join(F.broadcast(sums[k].select("lang", "total")), "lang").where(F.col("n") >= least_share * F.col("total")).withColumn("ctx", ctx)
        rows = kept.join(totals, ["lang", "ctx"]).select("lang", "gram", "n", "c").toArrow()
        number = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
        discount = np.array([min(0.9, max(0.1, s.n1 / (s.n1 + 2 * s.n2) if s.n1 else 0.5)) for s in (stats[k][x] for x in langs)])
        orders.append((number, rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy(), rows.column("c").to_numpy(), discount))
    return Model(langs, orders)


def identify(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", keep: list[str] | None = None, least_share: float | None = None) -> DataFrame:
    """``row`` (struct of ``keep``) with lang_pred, score, cross_entropy and rejected; learned from the rows where ``learn`` holds."""
    spark = df.sparkSession
    taught = df.where(F.coalesce(learn, F.lit(False)))
    held = spark.sparkContext.broadcast(train(taught, text, lang, least_share))
    langs = held.value.langs

    def run(_, texts, *given):
        n = len(texts)
        if not langs:
            return {"lang_pred": ["und"] * n, "score": np.zeros(n), "cross_entropy": pa.nulls(n, pa.float64()), "own": given[0]}
        bits, letters = held.value.entropies(texts)
        best = bits.argmin(1)
        least = bits[np.arange(n), best]
        share = 1 / np.exp2(-TEMPERATURE * (bits - least[:, None])).sum(1)
        return {
            "lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, letters)],
            "score": np.where(letters, share, 0.0),
            "cross_entropy": pa.array(least, mask=~letters),
            "own": given[0],
        }

    own = F.when(F.coalesce(learn, F.lit(False)), F.col(f"`{lang}`").cast("string"))  # the language that a row was learned as
    fields = [("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("own", "string")]
    scored = C.materialize(C.map_texts(df, text, keep or df.columns, run, fields, given=[own]), "languages")
    found = scored.where("lang_pred = own").groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", F.lit(REJECT), F.lit(ACCURACY)).alias("most")).collect()  # a row a language
    most = F.lit(float("inf"))
    for r in found:
        most = F.when(F.col("lang_pred") == r.lang_pred, r.most).otherwise(most)
    return scored.select("row", "lang_pred", "score", "cross_entropy", (F.col("cross_entropy").isNull() | (F.col("cross_entropy") > most)).alias("rejected"))
