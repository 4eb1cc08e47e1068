"""Hybrid search of queries in the vector index (OP-38, OP-44, OP-47 to OP-53).

Queries and rows are both dealt to parts, and each part of the one meets each part of the other in a task: neither passes through the
driver.  A task holds its queries (``QUERY_BLOCK`` at most) and reads its rows as a stream, by falling number, so that a query whose ``k``-th
row has the highest score is done.  It hands on the best ``k`` rows a query and store; a window with a pushed group limit picks the final ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.session import keep

# Candidates a query and store, bonus a shared word, score limit, judge's cut.
TOP, BONUS, LIMIT, CUT = 15, 0.05, 1.0, 0.70
QUERY_BLOCK, GROUPS = 32_768, 64  # queries of a group at most; groups of a larger search at least
ROWS, TILE, PAIRS, WORDS = 1024, 512, 16_384, 256  # rows and queries of a tile, pairs scored at once, words with a column
DIGITS = 9  # scores are compared at this many decimals: ties go to the higher idx

_FIELDS = "query_id bigint, store string, idx bigint, cosine double, shared bigint, score double"


def queries(df: DataFrame, text: str = "text", vector: str = "vec", query_id: str = "query_id") -> DataFrame:
    """Query rows with their normalised text, words and numbers."""
    rows = df.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(text).alias("text"), F.col(vector).cast("array<double>").alias("vec")).withColumn("text_norm", X.normalize(F.col("text")))
    return rows.withColumns({"numbers": X.numbers(F.col("text_norm")), "tokens": X.tokens(F.col("text_norm"))})


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as an expression; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def hybrid_score(similarity: Column, shared: Column) -> Column:
    return F.least(F.lit(LIMIT), similarity + shared * BONUS)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1))
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)


def _rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrow lists as one matrix; null lists and those of another width are zero."""
    size = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(vectors), width))
    if width:
        out[size == width] = flat[np.repeat(size == width, size)].reshape(-1, width)
    return out


class _Best:
    """The best ``k`` rows of each query by (score, idx), best first; only rows that reach ``floor`` get in."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.count = k, floor.copy(), np.zeros(len(floor), np.int64)
        self.held = [np.zeros((len(floor), k), t) for t in (float, np.int64, float, np.int64, float)]

    def add(self, q: np.ndarray, idx: np.ndarray, cos: np.ndarray, shared: np.ndarray, score: np.ndarray) -> None:
        ranked = np.round(score, DIGITS)
        enough = ranked >= self.floor[q]
        who, owner = np.unique(q[enough], return_inverse=True)
        taken = np.arange(self.k) < self.count[who, None]
        owner = np.concatenate((np.nonzero(taken)[0], owner))
        columns = [np.concatenate((h[who][taken], x[enough])) for h, x in zip(self.held, (ranked, idx, cos, shared, score))]
        order = np.lexsort((columns[1], columns[0], owner))
        owner = owner[order]
        place = np.searchsorted(owner, owner, "right") - 1 - np.arange(len(owner))
        keep = place < self.k
        at = who[owner[keep]], place[keep]
        for h, x in zip(self.held, columns):
            h[at] = x[order][keep]
        self.count[who] = np.minimum(self.k, np.bincount(owner, minlength=len(who)))
        full = who[self.count[who] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.held[0][full, -1])

    def found(self) -> list[np.ndarray]:
        """query, idx, cosine, shared, score."""
        taken = np.arange(self.k) < self.count[:, None]
        return [np.nonzero(taken)[0], *(h[taken] for h in self.held[1:])]


class Asked:
    """A group of queries, and their best rows so far of each store.

    Frequent words of the queries are columns beside the vectors, so that one product of single precision bounds the score of a tile of
    rows and queries; rare ones are added where they meet.  Pairs that may come in by that bound are scored in double precision.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, tokens: pa.Array, k: int, falling: bool = False, floors: dict[str, np.ndarray] | None = None):
        """``falling``: rows come by falling idx, so that none gets in by a tie; ``floors``: a score that a store's rows must reach."""
        self.ids, self.unit, self.k, self.falling, self.floors, self.bests = ids, unit, k, falling, floors or {}, {}
        row, code, words = _words(tokens)
        times = np.bincount(code, minlength=len(words))
        often = np.argsort(-times, kind="stable")[:WORDS]
        often = often[times[often] * WORDS >= len(ids)]
        self.column = {words[c]: n for n, c in enumerate(often)}
        self.often = self._columns(len(ids), row, code, words)
        by_code = np.argsort(code, kind="stable")
        self.rare = {w: rows for w, rows in zip(words, np.split(row[by_code], np.cumsum(times)[:-1])) if w not in self.column}
        self.mixed = np.hstack((unit, self.often * BONUS)).astype(np.float32)
        self.error = (self.mixed.shape[1] + 8) * 2.0**-22 * (1 + BONUS * np.bincount(row, minlength=1).max(initial=0))

    def _columns(self, n: int, row: np.ndarray, code: np.ndarray, words: list[str]) -> np.ndarray:
        place = np.array([self.column.get(w, -1) for w in words], np.int64)[code] if words else code
        out = np.zeros((n, len(self.column)), np.float32)
        out[row[place >= 0], place[place >= 0]] = 1
        return out

    def best(self, store: str) -> _Best:
        if store not in self.bests:
            self.bests[store] = _Best(self.floors.get(store, np.full(len(self.ids), -np.inf)), self.k)
        return self.bests[store]

    def shared_at_most(self, tokens: pa.Array) -> np.ndarray:
        """How many of each query's words the rows hold together."""
        words = set(tokens.flatten().unique().to_pylist())
        out = self.often @ np.array([w in words for w in self.column], np.float32)
        for w in words & self.rare.keys():
            out[self.rare[w]] += 1
        return out

    def add(self, store: str, idx: np.ndarray, unit: np.ndarray, tokens: pa.Array, live: np.ndarray | None = None) -> None:
        """Score rows of a store for the queries at ``live`` (default: all that can still change)."""
        best = self.best(store)
        if live is None:
            live = np.flatnonzero(best.floor < LIMIT) if self.falling else np.arange(len(self.ids))
        if not len(live) or not len(idx):
            return
        row, code, words = _words(tokens)
        often = self._columns(len(idx), row, code, words)
        mixed = np.hstack((unit.astype(np.float32), often))
        rare = [(row[code == c], self.rare[w]) for c, w in enumerate(words) if w in self.rare]
        tile = max(TILE, TILE * ROWS // len(idx))
        for at in range(0, len(live), tile):
            few = live[at : at + tile]
            bound = mixed @ self.mixed[few].T
            extra = np.zeros(bound.shape, np.int16) if rare else None
            for rows, qs in rare:
                n = np.searchsorted(few, qs)  # both are sorted
                n = n[few[np.minimum(n, len(few) - 1)] == qs]
                if len(n):
                    extra[np.ix_(rows, n)] += 1  # a row's words differ
            if rare:
                bound += extra * np.float32(BONUS)
            need = best.floor[few]
            fresh = np.flatnonzero(np.isinf(need))
            if len(fresh) and len(idx) > self.k:
                need[fresh] = np.minimum(LIMIT, np.partition(bound[:, fresh], len(idx) - self.k, axis=0)[len(idx) - self.k]) - self.error
            near, at_q = np.nonzero(bound >= (need - self.error).astype(np.float32))
            for start in range(0, len(near), PAIRS):
                r, n = near[start : start + PAIRS], at_q[start : start + PAIRS]
                q = few[n]
                cos = np.einsum("ij,ij->i", unit[r], self.unit[q])
                shared = np.einsum("ij,ij->i", often[r], self.often[q]).astype(np.int64) + (extra[r, n] if rare else 0)
                best.add(q, idx[r], cos, shared, np.minimum(LIMIT, cos + shared * BONUS))

    def found(self) -> Iterator[pa.RecordBatch]:
        for store, best in self.bests.items():
            q, *rest = best.found()
            for at in range(0, len(q), 1 << 16):
                some = slice(at, at + (1 << 16))
                ids = self.ids[q[some]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([store] * len(ids), pa.string()), *(pa.array(x[some]) for x in rest)], names=[c.split()[0] for c in _FIELDS.split(", ")])


def _words(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and code of each word of the rows, and the words by code."""
    held = tokens.flatten().dictionary_encode()
    return np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy()), held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary.to_pylist()


def _parts(n_queries: int, n_rows: int) -> tuple[int, int]:
    """Into how many parts queries and rows are dealt: at most ``QUERY_BLOCK`` queries and some 2^33 pairs in a group, and enough groups for many tasks."""
    qp, rp = max(1, math.ceil(n_queries / QUERY_BLOCK)), 1
    while (pairs := n_queries * n_rows / (qp * rp)) > 1 << 33 or (pairs > 1 << 22 and qp * rp < GROUPS):
        if n_rows / rp > n_queries / qp:
            rp *= 2
        else:
            qp *= 2
    return qp, rp


def meet(qs: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, run, fields: str, deal: Column, order: list[Column], more: tuple[str, ...] = ()) -> DataFrame:
    """Each part of the queries beside each part of the rows: ``run(queries, batches of rows)`` for each such group, whose rows come in ``order``.

    ``qs`` has (query_id, vec, tokens, floors), ``rows`` (store, idx, vec, tokens, ``more``), dealt by the number ``deal``.
    """
    qp, rp = _parts(n_queries, n_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = (F.col("qp") * rp + F.col("rp")).cast("int").alias("group")
    asked = qs.withColumn("qp", F.pmod(F.xxhash64("query_id"), F.lit(qp)).cast("int")).withColumn("rp", each(rp))
    rows = rows.withColumn("rp", F.pmod(deal, F.lit(rp)).cast("int")).withColumn("qp", each(qp))
    null = lambda df, c, name: F.lit(None).cast(df.schema[c].dataType).alias(name)
    asked = asked.select(group, F.lit(0).alias("kind"), F.col("query_id").alias("id"), null(rows, "store", "store"), F.col("vec").alias("asked"), null(rows, "vec", "vec"), "tokens", "floors", *(null(rows, c, c) for c in more))
    rows = rows.select(group, F.lit(1).alias("kind"), F.col("idx").alias("id"), "store", null(qs, "vec", "asked"), "vec", "tokens", null(qs, "floors", "floors"), *more)

    def groups(batches):
        """Runs of one group; the queries of a group come before its rows."""
        at, asked, begun = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = batch.column(0).to_numpy()
            for start, stop in _runs(group):
                if group[start] != at:
                    if begun is not None:
                        yield from begun.found()
                    at, asked, begun = group[start], [], None
                n = int((batch.column(1).slice(start, stop - start).to_numpy() == 0).sum())
                if n:
                    asked.append(table.slice(start, n))
                if n < stop - start and asked:
                    if begun is None:
                        begun = run(pa.concat_tables(asked).combine_chunks())
                    for k in range(start + n, stop, ROWS):
                        begun.rows(batch.slice(k, min(ROWS, stop - k)))
        if begun is not None:
            yield from begun.found()

    met = asked.unionByName(rows).repartitionById(qp * rp, F.col("group")).sortWithinPartitions("group", "kind", *order)
    return met.mapInArrow(groups, fields)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *ends], [*ends, len(values)]) if len(values) else ()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def width_of(qs: DataFrame) -> int:
    return qs.agg(F.max(F.size("vec"))).first()[0] or 0  # one row; -1 if there is no vector


class _Scan:
    def __init__(self, queries: pa.Table, width: int, k: int):
        self.width = width
        self.asked = Asked(column(queries, "id").to_numpy(), _unit(_rows(column(queries, "asked"), width)), column(queries, "tokens"), k, falling=True)
        self.found = self.asked.found

    def rows(self, batch: pa.RecordBatch) -> None:
        store, idx, unit, tokens = batch.column("store"), batch.column("id").to_numpy(), _unit(_rows(batch.column("vec"), self.width)), batch.column("tokens")
        held = store.dictionary_encode()
        for n, s in enumerate(held.dictionary.to_pylist()):
            mine = np.flatnonzero(held.indices.to_numpy(zero_copy_only=False) == n)
            self.asked.add(s, idx[mine], unit[mine], tokens.take(pa.array(mine)))


def top_candidates(qs: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` index rows for each query and store: (query_id, store, idx, cosine, shared, score, rank).

    Queries of equal vector and words have equal answers: one of them is searched, and its rows are handed to all.
    """
    qs = keep(qs.select("query_id", "vec", "tokens"), "asked")
    one = keep(qs.select("vec", "tokens").distinct().withColumn("one", F.monotonically_increasing_id()), "different")
    width = max(0, width_of(one))
    rows = index.select("store", "idx", "vec", "tokens")
    asked = one.select(F.col("one").alias("query_id"), "vec", "tokens", F.lit(None).cast("int").alias("floors"))
    found = meet(asked, rows, one.count(), index.count(), lambda queries: _Scan(queries, width, k), _FIELDS, F.xxhash64("store", "idx"), [F.col("store"), F.desc("id")])
    order = Window.partitionBy("query_id", "store").orderBy(F.desc(F.round("score", DIGITS)), F.desc("idx"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("query_id", "one")
    same = qs.alias("q").join(one.alias("o"), F.col("q.vec").eqNullSafe(F.col("o.vec")) & F.col("q.tokens").eqNullSafe(F.col("o.tokens"))).select("query_id", "one")
    return same.join(best, "one").drop("one")


def number_match(asked: Column, held: Column) -> Column:
    """Every asked number is among the held ones; true if none is asked."""
    return F.size(F.array_except(asked, held)) == 0


def judge(similarity: Column, flag: Column) -> Column:
    """The match rule: similar enough and the numbers agree."""
    return (similarity >= CUT) & (flag == 1)


def pick(candidates: DataFrame, qs: DataFrame, index: DataFrame, model=None) -> DataFrame:
    """One row for each query and store: the best ranked candidate whose numbers agree, else the best ranked one.

    ``is_match`` is told by the rule, or by a ``model`` of ``learned_judge``.
    """
    meta = index.select("store", "idx", "sku", "titulo", "precio", "cantidad", F.col("numbers").alias("held"))
    rows = candidates.join(meta, ["store", "idx"]).join(qs.select("query_id", F.col("numbers").alias("asked")), "query_id")
    rows = rows.withColumn("flag", number_match(F.col("asked"), F.col("held")).cast("int"))
    order = Window.partitionBy("query_id", "store").orderBy(F.desc("flag"), "rank")
    rows = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    match = judge(F.col("score"), F.col("flag"))
    if model is not None:
        rows = model.transform(rows.withColumns({"similitud_texto": F.col("score"), "misma_dimension": F.col("flag")}))
        match = F.col("prediction") == 1
    return rows.select("query_id", "store", "idx", "sku", "titulo", "precio", "cantidad", F.col("score").alias("similarity"), F.col("flag").alias("number_match"), match.alias("is_match"))


def judge_training(spark, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Synthetic rows for a learned judge, labelled by the rule."""
    df = spark.range(rows).select((F.rand(seed) * 0.9 + 0.1).alias("similitud_texto"), (F.rand(seed + 1) < 0.5).cast("int").alias("misma_dimension"))
    return df.withColumn("es_match", judge(F.col("similitud_texto"), F.col("misma_dimension")).cast("int"))


def learned_judge(training: DataFrame):
    """A gradient-boosted judge (its cut lies only near the rule's); for ``pick``, or apply with ``transform`` and read ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=["similitud_texto", "misma_dimension"], outputCol="features")
    return Pipeline(stages=[assemble, GBTClassifier(labelCol="es_match", maxIter=20, maxDepth=3, seed=42)]).fit(training)
