"""A trained text encoder: hashed subword features, inverse document frequencies, a low-rank projection (OP-46).

Features of a text are the different words of its normalised form, between ``<`` and ``>``, and their parts of ``GRAMS``
characters; md5 deals them to ``BUCKETS``.  A feature that occurs f times weighs (1 + ln f) * idf, with idf = ln((1 + N) / (1 + n)) + 1
for n of N texts, and a text's weights are scaled to length one.

The projection is the space of the leading right singular vectors of the texts x features matrix, found by subspace iteration:
each sweep multiplies the basis by the matrix and its transpose, as a sum by bucket of what tasks have summed before, and makes it
orthonormal.  A sweep reads the texts' words once and shuffles a row for each bucket and task.

Texts share most of their words, so a task works out the features of a word once, as long as it knows the word.  Work is dealt by the
partitions of the given rows: few files make few tasks, see ``session.spread``.

The model is a table (bucket, n, idf, vec) of at most ``BUCKETS`` rows, whatever the corpus: that bounds what
the driver holds between sweeps and what encoders broadcast (``rank`` * 4 bytes a bucket).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.functions import text as X
from priceloom.session import keep

BUCKETS, GRAMS, RANK, SWEEPS, SEED = 1 << 16, (3, 4), 128, 4, 42
ROWS, CELLS = 256, 1 << 22  # texts whose features a task multiplies at once, and cells of their block at most (but one text's)
KNOWN = 1 << 20  # features of known words that a task holds at most

MODEL = "bucket int, n bigint, idf double, vec array<float>"


def _words(text: Column) -> Column:
    return X.tokens(X.normalize(text))


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """The feature buckets of a text, with repeats; null gives none."""

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(buckets)
        for words in batches:
            row, bucket = known.features(words)
            ends = np.searchsorted(row, np.arange(len(words) + 1))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bucket.astype(np.int32)))

    return found(_words(text))


def document_frequencies(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): in how many texts each bucket occurs."""
    return _frequencies(texts.select(_words(F.col(text))), buckets)


def _frequencies(words: DataFrame, buckets: int) -> DataFrame:
    def count(batches):
        known, n = Known(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for rows, row, bucket in known.blocks(batch.column(0)):
                met, times = _times(rows, row, bucket, buckets)
                n[met] += np.count_nonzero(times, axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met])], names=["bucket", "n"])

    return words.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def inverse_frequency(n: Column, total: Column) -> Column:
    return F.log((1 + total) / (1 + n)) + 1


class Known:
    """The feature buckets of words, made once for each word as long as it is known."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.held = buckets, {}, 0

    def of(self, word: str) -> np.ndarray:
        made = self.known.get(word)
        if made is None:
            marked = f"<{word}>"
            parts = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
            made = np.array([int.from_bytes(md5(p.encode()).digest()[:4], "big") for p in parts], np.int64) % self.buckets
            if self.held + len(made) > KNOWN:
                self.known, self.held = {}, 0
            self.known[word] = made
            self.held += len(made)
        return made

    def features(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of each feature of Arrow lists of words, row by row."""
        each = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
        code = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        made = [self.of(w) for w in each.dictionary.to_pylist()]
        if not made:
            return row, code
        size = np.array([len(m) for m in made])
        n, start = size[code], (np.cumsum(size) - size)[code]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), np.concatenate(made)[at]

    def blocks(self, words: pa.Array, place: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(texts, row, bucket) of a few rows at a time, in order; ``place`` numbers the buckets that count, -1: none."""
        for at in range(0, len(words), ROWS):
            part = words.slice(at, ROWS)
            row, bucket = self.features(part)
            if place is not None:
                bucket = place[bucket]
                row, bucket = row[bucket >= 0], bucket[bucket >= 0]
            yield from _halved(len(part), row, bucket)


def _halved(rows: int, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Halves, until a block of texts by different features has ``CELLS`` cells at most."""
    if rows == 1 or rows * len(at) <= CELLS or rows * len(np.unique(at)) <= CELLS:
        yield rows, row, at
        return
    half = rows // 2
    cut = np.searchsorted(row, half)
    yield from _halved(half, row[:cut], at[:cut])
    yield from _halved(rows - half, row[cut:] - half, at[cut:])


def _times(rows: int, row: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur, and how often each does in each row."""
    seen = np.zeros(width, bool)
    seen[at] = True
    met = np.flatnonzero(seen)
    column = np.zeros(width, np.int64)
    column[met] = np.arange(len(met))
    return met, np.bincount(row * len(met) + column[at], minlength=rows * len(met)).reshape(rows, len(met))


class Weights:
    """A few texts' features as a dense block with rows of length one: they hold few different features, so it is small and multiplied at once."""

    def __init__(self, rows: int, row: np.ndarray, at: np.ndarray, idf: np.ndarray):
        self.met, times = _times(rows, row, at, len(idf))
        level = np.zeros(times.max(initial=0) + 1)
        level[1:] = 1 + np.log(np.arange(1, len(level)))
        self.block = level[times] * idf[self.met]
        norm = np.sqrt(np.einsum("ij,ij->i", self.block, self.block))[:, None]
        np.divide(self.block, norm, out=self.block, where=norm > 0)

    def times(self, basis: np.ndarray) -> np.ndarray:
        """rows x rank: each row's weighted sum of the basis' vectors."""
        return self.block @ basis[self.met]

    def add_back(self, values: np.ndarray, into: np.ndarray) -> None:
        """Add to each feature of ``into`` its weighted sum of the rows' ``values``."""
        into[self.met] += self.block.T @ values


def _places(found: np.ndarray, buckets: int) -> np.ndarray:
    place = np.full(buckets, -1, np.int64)
    place[found] = np.arange(len(found))
    return place


def fit(texts: DataFrame, text: str = "text", rank: int = RANK, buckets: int = BUCKETS, sweeps: int = SWEEPS, seed: int = SEED) -> DataFrame:
    """The model table of all ``texts``."""
    spark = texts.sparkSession
    # the words are written once, as every sweep reads them; sorted, so that a block's texts share features
    rows = keep(texts.where(F.col(text).isNotNull()).select(_words(F.col(text)).alias("words")).sortWithinPartitions("words"), "words")
    counted = _frequencies(rows, buckets).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row
    counted = counted.select("bucket", "n", inverse_frequency(F.col("n"), F.col("total")).alias("idf")).orderBy("bucket").toPandas()  # ``buckets`` rows at most
    found, idf = counted.bucket.to_numpy(), counted.idf.to_numpy()
    place, rank = _places(found, buckets), min(rank, len(found))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(found), rank)))[0] if rank else np.zeros((len(found), 0))
    for _ in range(sweeps if rank else 0):
        held = spark.sparkContext.broadcast((basis, idf, place))

        def multiply(batches, held=held):
            basis, idf, place = held.value
            known, out = Known(buckets), np.zeros_like(basis)
            for batch in batches:
                for block in known.blocks(batch.column(0), place):
                    w = Weights(*block, idf)
                    w.add_back(w.times(basis), out)
            met = np.flatnonzero(out.any(1))
            for at in range(0, len(met), 4096):
                few = met[at : at + 4096]
                flat = pa.array(out[few].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(few), pa.ListArray.from_arrays(pa.array(np.arange(len(few) + 1, dtype=np.int32) * basis.shape[1]), flat)], names=["at", "vec"])

        summed = rows.mapInArrow(multiply, "at bigint, vec array<double>").select("at", array_to_vector("vec").alias("vec")).groupBy("at").agg(vector_to_array(Summarizer.sum(F.col("vec"))).alias("vec"))
        got = summed.toArrow()  # a row for each bucket
        product = np.zeros_like(basis)
        product[got.column("at").to_numpy()] = got.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, rank)
        basis = np.linalg.qr(product)[0]
        held.unpersist()
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * rank), pa.array(basis.astype(np.float32).ravel()))
    table = pa.table({"bucket": pa.array(found, pa.int32()), "n": pa.array(counted.n.to_numpy(), pa.int64()), "idf": pa.array(idf, pa.float64()), "vec": vectors})
    return spark.createDataFrame(table).select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in MODEL.split(", ")))


def write(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def encode(df: DataFrame, model: DataFrame, text: str = "text", vector: str = "vec", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the model's vector of ``text`` (zero without known features)."""
    table = model.orderBy("bucket").toArrow()  # ``buckets`` rows at most
    vectors = table.column("vec").combine_chunks()
    basis = vectors.flatten().to_numpy().reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.float32)
    held = df.sparkSession.sparkContext.broadcast((basis, table.column("idf").to_numpy(), _places(table.column("bucket").to_numpy(), buckets)))
    src = df.select(_words(F.col(text)).alias("words"), F.struct("*").alias("row"))

    def run(batches):
        basis, idf, place = held.value
        known = Known(buckets)
        for batch in batches:
            at = 0
            for block in known.blocks(batch.column(0), place):
                found, part = Weights(*block, idf).times(basis).astype(np.float32), batch.slice(at, block[0])
                at += block[0]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * basis.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(1), vectors], names=["row", "vec"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("vec", T.ArrayType(T.FloatType()))])).select("row.*", F.col("vec").alias(vector))
