"""Operator 8: byte-level BPE encoding and decoding.

Encoding
1. Texts are split by the tokenizer's pattern in the JVM; the distinct words are counted.
2. Spark's higher-order functions fold the ranked merges over the bytes of a distinct word
   (``fold_merges``): the lowest rank, leftmost first, is merged until none is left.  The rank map
   is a literal: an array of small maps, so that a look-up scans one bucket.  Bytes are carried as the
   characters U+0000 to U+00FF, which the map's keys use too.
3. The ``HOT`` most frequent words (a fixed bound) are folded once; their hashes and ids are
   broadcast with the words' bytes, and documents are encoded in place.  The words of a document outside that table are
   folded in its own row by the same expression, and fill the gaps.  The rows are written with their
   words' numbers before that, so a task feeds one Python worker at a time.  No word is dropped and
   no document is shuffled.
Words of more than ``LONG`` bytes would make the fold quadratic; those few are merged with a heap
instead, with the same outcome.

Decoding concatenates the binary pieces of the ids.

Null and empty texts have no ids.  A very long text is a row like others, with its words in slices.  Ties:
of equal ranks the leftmost pair merges; words of equal count are all in the table or all outside.  Rows stay
rows, so repeated rows and null ids need no care.  An empty table gives an empty table.  The given columns stay in
``row``, so no name can clash; ``decode`` adds ``decoded`` to ``keep``, which must not hold that name.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

HOT, LONG, BUCKETS = 1 << 20, 256, 1 << 16
#: Characters of a plan's description; the driver keeps those of past queries, and the rank map would fill them.
PLAN_CHARS = 1 << 16
#: A rank above all, bits of a place in a word, and the longest word that the fold takes.
_NONE, _WIDTH = 1 << 20, 14
MOST = (1 << _WIDTH) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level BPE: lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ---------------------------------------------------------------- merges as expressions


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map: bucket number (crc32) to a map of piece to rank; folded to a literal by the optimizer."""
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        table[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(table)), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word given as a string of at most ``MOST`` bytes.

    The state is one array of numbers, a number for each pair of neighbouring pieces: the rank of their
    concatenation (``_NONE``: no piece), then where the left one starts, where the right one starts and where it
    stops.  So the least number is the lowest rank, leftmost first; merging takes it out and gives its
    neighbours new ranks.
    """

    def encode(table: Column, piece: Column) -> Column:
        def rank(start: Column, stop: Column) -> Column:
            part = F.substring(piece, start + 1, stop - start)
            return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.crc32(part.cast("binary")), F.lit(BUCKETS)).cast("int")), part), F.lit(_NONE))

        def pair(a: Column, b: Column, c: Column) -> Column:
            places = F.shiftleft(F.shiftleft(a, _WIDTH).bitwiseOR(b).cast("bigint"), _WIDTH).bitwiseOR(c)
            return F.shiftleft(rank(a, c).cast("bigint"), 3 * _WIDTH).bitwiseOR(places)

        left, middle, right = ((lambda v, k=k: F.shiftright(v, k * _WIDTH).bitwiseAND(MOST).cast("int")) for k in (2, 1, 0))

        def merge(pairs: Column, _: Column) -> Column:
            def at(low: Column) -> Column:
                a, b, c = left(low), middle(low), right(low)
                return F.transform(F.filter(pairs, lambda v: v != low), lambda v: F.when(middle(v) == a, pair(left(v), a, c)).when(left(v) == b, pair(a, c, right(v))).otherwise(v))

            return _let(F.array_min(pairs), lambda low: F.when(low < (_NONE << 3 * _WIDTH), at(low)).otherwise(pairs))

        def pieces(pairs: Column) -> Column:
            return F.concat(F.transform(pairs, lambda v: rank(left(v), middle(v))), F.array(_let(F.element_at(pairs, -1), lambda v: rank(middle(v), right(v)))))

        n = F.length(piece)
        first = F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 1, i + 2))
        return _let(rank(F.lit(0), n), lambda whole: F.when(whole < _NONE, F.array(whole)).when(n > 1, F.aggregate(F.sequence(F.lit(3), n), first, merge, pieces)).otherwise(F.array().cast("array<int>")))

    return _let(rank_literal(ranks), lambda table: _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda piece: encode(table, piece)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of candidate pairs and a linked list of pieces."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := prev[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return merge_long(word, ranks) if (one := ranks.get(word)) is None else [one]


# ---------------------------------------------------------------- documents


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


class HotWords:
    """``words``, found by the 64-bit hashes in ``numbers``; the ids of the k-th are ids[off[k + 1] : off[k + 2]], none for -1."""

    def __init__(self, batches: list[pa.RecordBatch], most: int):
        words = [pa.array([], pa.large_binary())]
        keys, sizes, ids = [np.zeros(0, C.U64)], [np.zeros(2, np.int32)], [np.zeros(0, np.int32)]
        small = np.min_scalar_type(most)
        for batch in batches:
            lists = batch.column("ids")
            off = lists.offsets.to_numpy()
            keys.append(C.hash_each(batch.column("word")))
            words.append(batch.column("word").cast(pa.large_binary()))
            sizes.append(np.diff(off).astype(np.int32))
            ids.append(lists.values.to_numpy()[off[0] : off[-1]].astype(small))
        keys = np.concatenate(keys)
        self.ids, self.off = np.concatenate(ids), np.cumsum(np.concatenate(sizes), dtype=np.int32)
        self.numbers, self.words = C.Lookup(keys, np.arange(len(keys), dtype=np.uint32)), pa.concat_arrays(words)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[s : s + n]."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])]


def slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of lists that hold at most ``most`` values together, or one list."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to


def hot_words(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, most: int, long: int) -> HotWords:
    """The most frequent words: all whose count is at least a bound that keeps them within ``most``."""
    counted = df.select(F.explode(words(F.col(f"`{text}`"), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = C.materialize(counted.where(F.octet_length("word") <= long), "words")
    least = C.least_count(counted, most)
    hot = counted.where(F.col("n") >= least)
    return HotWords(hot.select("word", fold_merges(F.col("word"), ranks).alias("ids")).toArrow().to_batches(), max(ranks.values(), default=0))


class Pieces:
    """The pieces of all ranks in one byte array."""

    def __init__(self, ranks: dict[bytes, int]):
        by_rank = sorted((rank, piece) for piece, rank in ranks.items())
        size = np.zeros(by_rank[-1][0] + 2 if by_rank else 1, np.int64)
        size[[rank + 1 for rank, _ in by_rank]] = [len(piece) for _, piece in by_rank]
        self.data, self.start = np.frombuffer(b"".join(piece for _, piece in by_rank), np.uint8), np.cumsum(size)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """For each list (its bounds within ``ids``), its pieces one after the other."""
        ids = ids.astype(np.int64)
        size = self.start[ids + 1] - self.start[ids]
        off = np.concatenate([[0], np.cumsum(size)])[bounds]
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(off), pa.py_buffer(gather(self.data, self.start[ids], size))]).cast(pa.binary())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT, long: int = LONG) -> DataFrame:
    """``row`` (struct of ``keep``) and ``ids``, the token ids of the text."""
    return _encode(df, ranks, pattern, text, keep, hot, long, None)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT, long: int = LONG) -> DataFrame:
    """``encode`` with ``decoded``: the ids decoded again, in the task that made them."""
    return _encode(df, ranks, pattern, text, keep, hot, long, Pieces(ranks))


def _encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, keep: list[str] | None, hot: int, long: int, pieces: Pieces | None) -> DataFrame:
    if max(ranks.values(), default=0) >= _NONE:
        raise ValueError(f"ranks must be below {_NONE}")
    sc, long = df.sparkSession.sparkContext, min(long, MOST)
    C.settings(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    known = hot_words(df, text, ranks, pattern, hot, long)
    # in two parts: the workers that look words up hold no ids, and the other way round
    held_numbers, held_ids, held_ranks = sc.broadcast((known.numbers, known.words)), sc.broadcast((known.ids, known.off, pieces)), sc.broadcast(ranks)
    del known
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), words(F.col(f"`{text}`"), pattern).alias("words"))

    def fill(batches):
        hot_table, hot_bytes = held_numbers.value
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            for at, to in slices(bounds, 1 << 19):
                part = lists.values.slice(bounds[at], bounds[to] - bounds[at])
                code, different = C.numbered(part)
                found = C.confirmed(hot_table, hot_bytes, different)[code] + 1  # from 1; 0 is no hot word
                cut = bounds[at : to + 1] - bounds[at]
                gaps = np.flatnonzero(found == 0)
                gap_cut = pa.array(np.searchsorted(gaps, cut).astype(np.int32))
                numbers = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), numbers, pa.ListArray.from_arrays(gap_cut, part.take(pa.array(gaps)).cast(pa.string()))], names=["row", "numbers", "gaps"])

    def unpack(batches):
        known_ids, known_off, pieces = held_ids.value
        for batch in batches:
            bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
            for at, to in slices(bounds, 1 << 16):
                part = batch.slice(at, to - at)
                number = part.column(1).flatten().to_numpy().astype(np.int64)
                folded = part.column(3).flatten()
                if folded.null_count:  # words that the fold does not take
                    folded = pa.array([merge_word(w.encode(), held_ranks.value) if x is None else x for w, x in zip(part.column(2).flatten().to_pylist(), folded.to_pylist())], pa.list_(pa.int32()))
                gap = number == 0
                start = known_off[number].astype(np.int64)
                size = known_off[number + 1] - start
                own = folded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                start[gap], size[gap] = np.cumsum(own) - own, own
                stop = np.cumsum(size)
                take, is_gap = np.repeat(start - stop + size, size) + np.arange(size.sum()), np.repeat(gap, size)
                ids = np.empty(len(take), np.int32)
                ids[~is_gap] = known_ids[take[~is_gap]]
                ids[is_gap] = folded.flatten().to_numpy()[take[is_gap]]
                off = np.concatenate([[0], stop])[bounds[at : to + 1] - bounds[at]]
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), *([pieces.join(ids, off)] if pieces else [])]
                yield pa.RecordBatch.from_arrays(out, names=["row", "ids", "decoded"][: len(out)])

    # written, so that no task feeds two Python workers at once
    filled = C.materialize(src.mapInArrow(fill, T.StructType([src.schema["row"], *T.StructType.fromDDL("numbers array<int>, gaps array<string>")])), "words-numbered")
    folded = filled.withColumn("folded", F.transform("gaps", lambda w: F.when(F.octet_length(w) <= long, fold_merges(w, ranks))))
    return folded.mapInArrow(unpack, T.StructType([src.schema["row"], *T.StructType.fromDDL("ids array<int>" + (", decoded binary" if pieces else ""))]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``encoded``'s columns ``keep`` with ``decoded``: the concatenated pieces of ``ids``, as binary; null ids give an empty one."""
    C.settings(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(Pieces(ranks))
    src = encoded.select(F.struct(*[F.col(f"`{c}`") for c in (keep if keep is not None else encoded.columns)]).alias("row"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        pieces = held.value
        for batch in batches:
            bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
            for at, to in slices(bounds, 1 << 18):
                ids = batch.column(1).values.to_numpy()[bounds[at] : bounds[to]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pieces.join(ids, bounds[at : to + 1] - bounds[at])], names=["row", "decoded"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], *T.StructType.fromDDL("decoded binary")])).select("row.*", "decoded")
