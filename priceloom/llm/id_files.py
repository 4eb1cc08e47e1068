"""Operator 11: token ids in binary files of bit planes, in order of the document ids.

Writing
1. Documents are dealt by range of (document id, hash of the text, place in the input), so a document id that
   many rows share is split like any other range, and sorted within their partition.
2. A task encodes its texts with the tokenizers library and ends each with ``END``.  White space never reaches a
   token of this vocabulary and its splitter parts letters from other characters, so texts are encoded in units, each
   different unit once as long as the worker remembers it (``word_store``).
3. Ids go into blocks of ``BLOCK``; a block is transposed into planes (one for each bit, or each byte, that
   its largest id needs) and every plane is compressed with Zstandard alone.  A file takes ``FILE_IDS`` ids; it ends
   with the documents' ids and lengths, the chunk index (where each plane of each block lies) and a trailer.
4. The list of files goes through Spark's own commit; files of lost or repeated attempts are on no list.

Reading: ``IdFile`` opens a file by its trailer and index and gives any range of ids from the blocks that hold it.
``read_files`` hands the listed files to tasks, adds the ids of all files before each, and returns a row for each document.

Null and empty texts are the end id alone.  A very long text spans blocks, not files.  Ties: rows of one document id follow
each other by the hash of their texts, then as they come; null ids come first.  Repeated rows are all written.  An
empty table writes nothing and reads as no rows.  Of further columns nothing is read, so no name can clash.
Strings of special tokens inside texts get the special ids, as the library does by default; ``special=False``
makes them plain text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .warc import qualified
from .word_store import WordStore

END, BLOCK, FILE_IDS, LEVEL = 1, 1 << 16, 1 << 24, 3
#: Bytes of text that are encoded at once, and different units that a worker keeps.
CHUNK_BYTES, WORDS = 1 << 22, 1 << 20
IS_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
MAGIC, TRAILER = b"IDPLANE1", struct.Struct("<QQ8s")
#: Of a block in the index: ids, width of an id in planes; then (offset, bytes) of each plane.
BLOCK_HEAD, PLACE = struct.Struct("<IB"), struct.Struct("<QI")

FILES = "part int, number int, path string, ids bigint, docs bigint"
ROWS = "path string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


# ---------------------------------------------------------------- planes


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first: of bits (eight ids a byte) or of bytes."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range((top + 7) // 8)]
    out = []
    for k in range((top + 7) // 8):
        rows = np.packbits(np.unpackbits(np.ascontiguousarray(octets[:, k])[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little")
        out += [row.tobytes() for row in rows[: top - 8 * k]]
    return out


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block from its planes."""
    octets = np.zeros((n, 4), np.uint8)
    for k in range(4):
        if bits and planes[8 * k : 8 * k + 8]:
            rows = np.zeros((8, (n + 7) // 8), np.uint8)
            for i, plane in enumerate(planes[8 * k : 8 * k + 8]):
                rows[i] = np.frombuffer(plane, np.uint8)
            octets[:, k] = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")[:, 0]
        elif not bits and k < len(planes):
            octets[:, k] = np.frombuffer(planes[k], np.uint8)
    return octets.view("<u4")[:, 0]


# ---------------------------------------------------------------- one file


class IdWriter:
    """Writes ids in blocks to an open stream; ``close`` adds documents, index and trailer."""

    def __init__(self, out, bits: bool = True, block: int = BLOCK, level: int = LEVEL):
        self.out, self.bits, self.block = out, bits, block
        self.codec = zstandard.ZstdCompressor(level=level)
        self.rest, self.waiting, self.ids = [], 0, 0
        self.doc_ids, self.sizes, self.index = [], [], []
        self.at = len(MAGIC)
        out.write(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        packed = self.codec.compress(data)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def _blocks(self, least: int) -> None:
        held = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        at = 0
        while len(held) - at >= least:
            part = held[at : at + self.block]
            self.index.append((len(part), [self._put(p) for p in planes_of(part, self.bits)]))
            at += len(part)
        self.rest, self.waiting = [held[at:]], len(held) - at

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append documents: their ids, how many tokens each has, and the tokens."""
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.rest.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.block:
            self._blocks(self.block)

    def close(self) -> None:
        self._blocks(1)
        known = np.array([d is not None for d in self.doc_ids], bool)
        values = np.array([d or 0 for d in self.doc_ids], np.int64)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        docs, _ = self._put(struct.pack("<Q", len(values)) + np.packbits(known).tobytes() + values.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
        listed = b"".join(BLOCK_HEAD.pack(n, len(places)) + b"".join(PLACE.pack(*p) for p in places) for n, places in self.index)
        index, _ = self._put(struct.pack("<BI", self.bits, len(self.index)) + listed)
        self.out.write(TRAILER.pack(docs, index, MAGIC))


class IdFile:
    """A file of ids, read through its chunk index; ``source`` has seek and read."""

    def __init__(self, source):
        self.source, self.codec = source, zstandard.ZstdDecompressor()
        source.seek(0, os.SEEK_END)
        end = source.tell() - TRAILER.size
        if end < len(MAGIC):
            raise ValueError("file of ids is cut short")
        docs, index, magic = TRAILER.unpack(self._read(end, TRAILER.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC or not len(MAGIC) <= docs <= index <= end:
            raise ValueError("not a file of ids")
        raw = self.codec.decompress(self._read(docs, index - docs))
        n = struct.unpack_from("<Q", raw)[0]
        known = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, 8), count=n).astype(bool)
        values, self.sizes = np.frombuffer(raw, "<i8", 2 * n, 8 + (n + 7) // 8).reshape(2, n)
        self.doc_ids = pa.array(values, mask=~known)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = self.codec.decompress(self._read(index, end - index))
        self.bits, blocks = struct.unpack_from("<BI", raw)
        at, self.index = 5, []
        for _ in range(blocks):
            n, planes = BLOCK_HEAD.unpack_from(raw, at)
            at += BLOCK_HEAD.size
            self.index.append((n, [PLACE.unpack_from(raw, at + k * PLACE.size) for k in range(planes)]))
            at += planes * PLACE.size
        self.starts = np.concatenate([[0], np.cumsum([n for n, _ in self.index], dtype=np.int64)])
        if self.starts[-1] != self.bounds[-1]:
            raise ValueError("the blocks do not hold the documents' ids")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n)
        if len(got) != n:
            raise ValueError("file of ids is cut short")
        return got

    def block(self, k: int) -> np.ndarray:
        n, places = self.index[k]
        return ids_of([self.codec.decompress(self._read(*p)) for p in places], n, bool(self.bits))

    def blocks(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` to ``stop``, in pieces no longer than a block."""
        for k in range(int(np.searchsorted(self.starts, start, "right")) - 1, len(self.index)):
            if self.starts[k] >= stop:
                return
            yield self.block(k)[max(0, start - self.starts[k]) : stop - self.starts[k]]

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.blocks(start, stop)])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))

    def checksums(self) -> list[int]:
        """crc32 of each document's ids as little-endian 32-bit integers; a block is decoded once."""
        out, doc, crc = [], 0, 0
        for k in range(len(self.index)):
            ids, at, base = self.block(k), 0, int(self.starts[k])
            raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
            while at < len(ids):
                stop = min(len(ids), int(self.bounds[doc + 1]) - base)
                crc = zlib.crc32(raw[4 * at : 4 * stop], crc)
                at = stop
                while doc < len(self.sizes) and self.bounds[doc + 1] == base + at:
                    out.append(crc)
                    doc, crc = doc + 1, 0
        return out + [0] * (len(self.sizes) - len(out))


# ---------------------------------------------------------------- Spark


@cache
def word_encoder(path: str, special: bool = True) -> WordStore:
    """The ids of text units by the tokenizer file at ``path``; a worker keeps it from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    model = tokenizer.model

    def make(units: list[bytes]):
        # lower-case ASCII letters pass the normalizers and the splitter unchanged, so the model can have them at once
        got = [[t.id for t in model.tokenize(u.decode())] if u.isalpha() and u.islower() else None for u in units]
        rest = [k for k, ids in enumerate(got) if ids is None]
        for k, e in zip(rest, tokenizer.encode_batch_fast([units[k].decode() for k in rest], add_special_tokens=False)):
            got[k] = e.ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return [(np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes)]

    store = WordStore(make, [np.int32], WORDS)
    store.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()] if special else []
    return store


def units(flat: C.Flat, special: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(the pieces that are encoded alone, text number of each): words, cut where letters meet other ASCII characters.

    The splitter's matches end at each of those places: white space is in none, and letters share one only with an apostrophe
    before them.  Around a special token's string words stay whole and keep their case.
    """
    data = flat.data
    whole = bool(special) and any(s in raw for raw in [data.tobytes()] for s in special)
    inside, letter = ~C.IS_SPACE[data], IS_LETTER[data]
    first = np.ones(len(data), bool)
    if len(data):
        a, b = data[:-1], data[1:]
        meet = (a < 128) & (b < 128) & (letter[:-1] != letter[1:]) & (a != 39) if not whole else np.zeros(len(a), bool)
        first[1:] = ~inside[:-1] | meet
        first[flat.off[:-1][flat.off[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & first)
    last = np.ones(len(data), bool)
    last[:-1] = first[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    off, held = np.concatenate([[0], np.cumsum(ends - starts)]), (data if whole else C.ASCII_LOWER[data])[inside]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(held)]), flat.text_of(starts)


def encode_chunk(store: WordStore, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts, each ended with ``end``; how many each has)."""
    flat = C.Flat(texts)
    pieces, owner = units(flat, store.special)
    ids, size = store.columns[0].take(store.rows(pieces))
    per_text = C.sums_by(owner, flat.n, size) if len(owner) else np.zeros(flat.n, np.int64)
    out = np.full(len(ids) + flat.n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(flat.n), per_text)] = ids
    return out, per_text + 1


def write_files(df: DataFrame, tokenizer: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, special: bool = True, bits: bool = True, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files below ``path`` (default: the shared folder); returns the committed list of files (columns FILES)."""
    spark = df.sparkSession
    C.settings(spark)
    path = qualified(spark, path or f"{C.shared_dir(spark)}/priceloom/ids-{uuid.uuid4().hex}")
    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"), "text")
    dealt = rows.repartitionByRange("id", "h", "at").sortWithinPartitions("id", "h", "at").select("id", "text")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))  # Hadoop's names of the same store
        store.create_dir(root, recursive=True)
        words, part, number, out = word_encoder(tokenizer, special), TaskContext.get().partitionId(), 0, None

        def closed():
            out.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": f"{path}/{name}", "ids": out.ids, "docs": len(out.doc_ids)}], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

        for batch in batches:
            for piece in C.chunks(batch, "text", CHUNK_BYTES):
                ids, sizes = encode_chunk(words, piece.column(1), end)
                doc_ids, bounds, at = piece.column(0).to_pylist(), np.concatenate([[0], np.cumsum(sizes)]), 0
                while at < len(sizes):
                    if out is None:
                        name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                        out = IdWriter(stream, bits, block)
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + file_ids - out.ids, "right")) - 1)  # as many as fit, or one
                    out.add(doc_ids[at:to], sizes[at:to], ids[bounds[at] : bounds[to]])
                    at = to
                    if at < len(sizes) or out.ids >= file_ids:
                        yield closed()
                        out, number = None, number + 1
        if out is not None:
            yield closed()

    return C.materialize(dealt.mapInArrow(write, FILES), "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """A row for each document of the listed files (columns ROWS); ``start``: the ids of all documents before it."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = files.count()  # a row for each file of 16 million ids: the list is small beside what it lists
    listed = files.select("path", before.alias("before")).repartition(max(1, n))

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
                with store.open_input_file(name) as source:
                    f = IdFile(source)
                    found = [pa.array([path] * len(f.sizes), pa.string()), f.doc_ids, pa.array(f.bounds[:-1] + start), pa.array(f.sizes), pa.array(f.checksums(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(found, names=[c.split()[0] for c in ROWS.split(", ")])

    return listed.mapInArrow(read, ROWS)


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of ``df`` and read the files back."""
    return read_files(write_files(df, tokenizer, **options))


def read_range(spark: SparkSession, files: DataFrame, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of all files, for a reader of batches: a bounded range, from the blocks that hold it."""
    from pyarrow import fs

    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = [np.zeros(0, np.uint32)]
    for r in files.select("path", "ids", before.alias("before")).where((F.col("before") < stop) & (F.col("before") + F.col("ids") > start)).orderBy("before").collect():
        store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", r.path))
        with store.open_input_file(name) as source:
            out.append(IdFile(source).ids(max(0, start - r.before), min(r.ids, stop - r.before)))
    return np.concatenate(out)
