"""Shared helpers of the training-data operators: Arrow text chunks, numpy hashing, shared storage.

Every per-text computation of this subpackage runs as a Spark ``mapInArrow`` over
(row, text) pairs.  Inside a task the UTF-8 buffer of a few hundred texts is handled at
once with numpy; ``CHUNK_BYTES`` bounds the temporaries, whatever the batch size is.

Words and lines are compared by their bytes: Arrow's dictionary encoding numbers the different ones of
a chunk.  Where a value must be found outside its chunk, it is looked up by its XXH64 and held against its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.session import shared_dir

#: Bytes of text that are handled by numpy at once (a longer single text is handled alone).
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch at most; the session's own setting is lowered to it, not raised.
BATCH_ROWS = 1024
#: Different counts that a bound is chosen from, within one power of two.
FEW_COUNTS = 4096

#: White space of the contracts: U+0020 and U+0009 to U+000D.
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])

U64 = np.uint64


# ---------------------------------------------------------------- shared storage


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/priceloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def written() -> int:
    """How many tables ``materialize`` has written in this process and not released."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after the first ``since`` ones, the last ``keep`` excepted; results that read them must be saved before."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    _WRITTEN[since : len(_WRITTEN) - keep] = []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- texts as numpy


class Flat:
    """The texts of a chunk as one byte array with offsets; nulls read as empty."""

    def __init__(self, texts: pa.Array):
        self.valid = np.asarray(texts.is_valid())
        texts = texts.fill_null("").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n = len(texts)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text number) of the maximal runs of ``inside`` bytes, none crossing texts."""
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        bounds = self.off[:-1][self.off[:-1] < len(inside)]
        before[bounds] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        ends_of = self.off[1:][self.off[1:] > 0]
        after[ends_of - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, self.text_of(starts)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text number) of the \\n-split lines; an empty text has one empty line."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.off[:-1], cuts + 1]), kind="stable")
        owner = np.sort(np.concatenate([np.arange(self.n), self.text_of(cuts)]), kind="stable")
        ends = np.empty_like(starts)
        last = np.ones(len(starts), bool)
        last[:-1] = owner[1:] != owner[:-1]
        ends[:-1] = starts[1:] - 1
        ends[last] = self.off[1:]
        return starts, ends, owner


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


IS_SPACE = _table(WHITESPACE)
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges (in order, none overlapping) as one binary array."""
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, ends, 1)
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=off[1:])
    held = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(held)])


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, the different values): equal bytes, and only those, share a number."""
    held = values.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary


def hashes(values: pa.Array) -> np.ndarray:
    """XXH64 of each binary or string value."""
    numbers, different = numbered(values)
    return hash_each(different)[numbers]


def hash_each(values: pa.Array) -> np.ndarray:
    """XXH64 of each binary or string value, for values that differ."""
    return np.fromiter(map(xxhash.xxh64_intdigest, values.to_pylist()), U64, len(values))


def count_in(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Set entries of ``mask`` in each range; the ranges hold something and are in order."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.stack([starts, ends], 1).ravel()
    return np.add.reduceat(np.append(mask, False), bounds, dtype=np.int64)[::2]


def is_point(data: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes begin a code point."""
    return (data & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Lookup:
    """Values by 64-bit hash: sorted hashes, with the first row of each run of leading bits."""

    def __init__(self, h: np.ndarray, values: np.ndarray):
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]
        self.shift = U64(64 - max(1, len(h).bit_length() + 1))
        self.start = np.searchsorted(self.h >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        at, stop = self.start[slot], self.start[slot + 1]
        out = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            good = self.h[at[todo]] == h[todo]
            out[todo[good]] = at[todo[good]]
            todo = todo[~good]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out


def confirmed(table: Lookup, words: pa.Array, different: pa.Array) -> np.ndarray:
    """For each of some different words its place in ``words``, or -1: found by the hash in ``table`` (whose values are places), held against the bytes."""
    if not len(table.h) or not len(different):
        return np.full(len(different), -1, np.int64)
    at = table.find(hash_each(different))
    place = np.where(at >= 0, table.values[at], 0).astype(np.int64)
    same = pc.equal(words.take(pa.array(place)), different.cast(words.type)).to_numpy(zero_copy_only=False)
    return np.where((at >= 0) & same, place, -1)


def sums_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


# ---------------------------------------------------------------- Spark plumbing


def settings(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch, so that a task holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def least_count(counted: DataFrame, most: int, n: str = "n") -> int:
    """A count that at most ``most`` rows of ``counted`` reach; the least one where few rows have the same, and a power of two otherwise."""
    power = F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    rows = counted.where(F.col(n) > 0).groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 63 at most
    upto, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.power):
        if upto + r.rows > most:
            few = counted.where(power == r.power).groupBy(n).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc(n)).limit(FEW_COUNTS).collect()
            for x in few:
                if upto + x.rows > most:
                    break
                upto, least = upto + x.rows, x[n]
            break
        upto, least = upto + r.rows, 1 << r.power
    return least


def sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key``; tasks hand on about that many together, not each."""
    h, n = F.xxhash64(*key), df.count()
    if n > most:
        share = (most + 6 * most**0.5 + 6) / n
        few = df.where(h < int(min(2 * share - 1, 1 - 2**-10) * 2**63)) if share < 1 else df
        df = few if few.count() >= most else df
    return df.orderBy(h, *key).limit(most)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, text, keep: list[str], fn: Callable[..., dict], fields: list[tuple[str, str]], given: list | None = None) -> DataFrame:
    """Apply ``fn(rows, texts)`` to chunks of the column ``text`` (a name or a Column); returns ``row`` (a struct of ``keep``) and the new ``fields``.

    The kept columns travel inside the struct ``row``, so their names cannot clash with new ones.
    ``given``: more columns for ``fn(rows, texts, *given)``.  ``fn`` returns arrays by field name,
    and returns ``__take__`` (row numbers) when it emits another number of rows than it was given.
    """
    settings(df.sparkSession)
    more = [F.col(c) if isinstance(c, str) else c for c in given or []]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").alias("text"), *[c.alias(f"g{i}") for i, c in enumerate(more)])
    names = [name for name, _ in fields]
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), *T.StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in fields))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = part.column(0)
                got = fn(*part.columns)
                take = got.pop("__take__", None)
                if take is not None:
                    rows = rows.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([rows, *[got[f] if isinstance(got[f], pa.Array) else pa.array(got[f]) for f in names]], names=["row", *names])

    return src.mapInArrow(run, schema)
