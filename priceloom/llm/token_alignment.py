"""Operator 12: alignment of two tokenizers' tokens over the same bytes.

Aligning: a text (with a space before it) is cut at single spaces between characters that are no white space.  Tokens of neither
vocabulary cross such a place (``Pair`` checks this of the second one's pieces; the first one's splitter never matches
across it), so a worker aligns each different cut piece once and keeps the outcome (``word_store``).  Pieces are aligned
many at a time: ``union1d`` of both arrays of token ends gives the elementary intervals, ``searchsorted`` their owners
on both sides.  Each interval is one overlap of two tokens; ends that both sides share close groups; within a group
``products`` expands all pairs of its tokens.

Counting: a task counts in how many documents each id pair overlaps, merging as it goes, and one grouped sum gives the
corpus' counts, with the best of each first id.

Scoring: the ``HOT`` most frequent pairs are broadcast (16 bytes each) and documents are scored in place.  If there are more
pairs, the others' links are joined with their counts by pair, summed by document and added; none is left out.

Null and empty texts, and those whose tokens don't spell the text's bytes on both sides, have no tokens, groups or links.  A very
long text is a row like others; without single spaces it is one piece.  Ties: pairs of equal count are all best.  Repeated rows are
documents of their own, and null ids need no care.  An empty table gives an empty table.  Given columns stay in
``row``, so no name can clash.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .word_store import WordStore

HOT, MERGE = 1 << 20, 1 << 20
#: Bytes of text that are aligned at once.
CHUNK_BYTES = 1 << 22
SPACE, MARK = 0x20, "▁"
#: Different words of the first vocabulary's splitter that a worker keeps.
PARTS = 1 << 17

# What the splitter of byte-level vocabularies finds in printable ASCII and letters up to U+00FF without further spaces.
PLAIN = re.compile(" [!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ÿ]+")

#: Lead bytes of characters that are safe beside a cut: printable ASCII but space, and leads of no white space (which begins with C2, E1, E2 or E3).
SAFE = np.array([0x21 <= b <= 0x7E or 0xC4 <= b <= 0xDF or b == 0xC3 or 0xE4 <= b <= 0xF4 or b == 0xE0 for b in range(256)])
RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bytes:
    """The bytes of all ids of a vocabulary, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the elementary intervals, place of each one's first token, of its second, whether both end there)."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def products(groups: str) -> list[tuple[int, int]]:
    """All pairs of first and second ids within each group of ``align``'s ``groups``."""
    out = []
    for group in filter(None, groups.split(";")):
        a, b = (np.array(side.split(","), np.int64) for side in group.split("|"))
        out += zip(np.repeat(a, len(b)).tolist(), np.tile(b, len(a)).tolist())
    return out


class Pair:
    """Two tokenizers: a byte-level one of the tokenizers library and a sentencepiece model that adds a space."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.parts: dict[str, list[int]] = {}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        spelt: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            spelt[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in plain)
        self.bytes_a = Bytes(spelt)
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        self.width = len(pieces)
        self.letters = {b: c for c, b in letters.items()}
        self.decimals = [np.char.add(np.arange(max(len(spelt), len(pieces))).astype("S"), sign) for sign in (b",", b"|", b";")]
        self.decimals = [Bytes(x.tolist()) for x in self.decimals]

    def pieces(self, flat: C.Flat) -> tuple[pa.Array, np.ndarray]:
        """(texts with a space before each, cut; text number of each piece)."""
        lengths = np.diff(flat.off)
        off = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.full(off[-1], SPACE, np.uint8)
        inside = np.ones(off[-1], bool)
        inside[off[:-1]] = False
        data[inside] = flat.data
        first = ~inside
        if self.cuts and len(data) > 2:
            lead = (data & 0xC0) != 0x80
            at = np.flatnonzero((data == SPACE) & inside)
            at = at[(at > 0) & (at + 1 < len(data))]
            safe_after = SAFE[data[np.minimum(at + 1, len(data) - 1)]] & inside[np.minimum(at + 1, len(data) - 1)]
            at = at[safe_after]
            before = at - 1
            for _ in range(3):
                before = before - ~lead[before]
            first[at[SAFE[data[before]] & (before >= 0)]] = True
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(data))
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]), np.searchsorted(off, starts, "right") - 1

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        """The first tokenizer's ids; what ``PLAIN`` tells is split here, and each different part goes to the library's merges once."""
        known, tokenize, out, rest = self.parts, self.a.model.tokenize, [], []
        if len(known) > PARTS:
            known.clear()
        for k, text in enumerate(texts):
            ids: list[int] = []
            if PLAIN.fullmatch(text):
                for part in SPLIT.findall(text):
                    if (found := known.get(part)) is None:
                        found = known[part] = [t.id for t in tokenize(part.encode().decode("latin-1").translate(self.letters))]
                    ids += found
            else:
                rest.append(k)
            out.append(ids)
        for k, e in zip(rest, self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def make(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For different pieces: links, groups' text, and numbers (valid, first tokens, second tokens, groups)."""
        n = len(pieces)
        texts = [p.decode() for p in pieces]
        got_a = self.first_ids(texts)
        got_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        size_a, size_b = np.fromiter(map(len, got_a), np.int64, n), np.fromiter(map(len, got_b), np.int64, n)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(s.sum())) for x, s in ((got_a, size_a), (got_b, size_b)))
        valid = self.spells(pieces, a, size_a, self.bytes_a) & self.spells(pieces, b, size_b, self.bytes_b)
        if not valid.all():
            a, b = a[np.repeat(valid, size_a)], b[np.repeat(valid, size_b)]
            size_a, size_b = size_a * valid, size_b * valid
        ends, at_a, at_b, shared = intervals(np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b]))
        links = a[at_a] * self.width + b[at_b]
        owner = np.repeat(np.arange(n), size_a)[at_a]
        n_links = np.bincount(owner, minlength=n)
        n_groups = np.bincount(owner[shared], minlength=n)
        # the tokens of both sides in order of group, side and place, each with the sign that follows it
        group = np.cumsum(shared) - shared
        group_a, group_b = (group[np.searchsorted(x, np.arange(len(y)), "left")] for x, y in ((at_a, a), (at_b, b)))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        side = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
        last = np.append(side[1:] != side[:-1], True)[: len(side)]
        sign, ids = np.where(last, 1 + side % 2, 0), np.concatenate([a, b])[order]
        width = np.choose(sign, [d.size[ids] for d in self.decimals])
        start = np.choose(sign, [d.start[ids] + base for d, base in zip(self.decimals, np.cumsum([0, *(len(d.data) for d in self.decimals[:2])]))])
        stop = np.cumsum(width)
        told = self.signs[np.repeat(start - stop + width, width) + np.arange(int(stop[-1]) if len(stop) else 0)]
        whose = np.concatenate([np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)])[order]
        numbers = [valid, size_a, size_b, n_groups]
        return [(links, n_links), (told, np.bincount(whose, width, n).astype(np.int64)), (np.stack(numbers, 1).astype(np.int64).ravel(), np.full(n, len(numbers), np.int64))]

    @property
    def signs(self) -> np.ndarray:
        if not hasattr(self, "_signs"):
            self._signs = np.concatenate([d.data for d in self.decimals])
        return self._signs

    @staticmethod
    def spells(pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray, spelt: Bytes) -> np.ndarray:
        """Which pieces have tokens whose bytes joined are the piece."""
        joined, n = spelt.of(ids), len(pieces)
        bounds = np.concatenate([[0], np.cumsum(spelt.size[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        good = np.diff(bounds) == np.fromiter(map(len, pieces), np.int64, n)
        if good.all() and joined.tobytes() == b"".join(pieces):
            return good
        return np.fromiter((joined[bounds[k] : bounds[k + 1]].tobytes() == pieces[k] for k in range(n)), bool, n)

    def store(self) -> WordStore:
        return WordStore(self.make, [np.int64, np.uint8, np.int64])


@cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


@cache
def store_of(path_a: str, path_b: str) -> WordStore:
    """Kept by a worker from task to task."""
    return pair_of(path_a, path_b).store()


def rows_of(pair: Pair, store: WordStore, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(store rows of the pieces of all texts that have tokens, text number of each).

    A piece that its tokens don't spell makes its text be aligned as a whole, which then has tokens only if these spell it.
    """
    flat = C.Flat(texts)
    pieces, owner = pair.pieces(flat)
    filled = np.diff(flat.off)[owner] > 0
    pieces, owner = pieces.filter(pa.array(filled)), owner[filled]
    rows, numbers = store.rows(pieces), store.columns[2]
    broken = np.zeros(flat.n, bool)
    broken[owner[numbers.held[numbers.bounds[rows]] == 0]] = True
    if broken.any():
        kept, whole = ~broken[owner], np.flatnonzero(broken)
        more = store.add([b" " + flat.data[flat.off[k] : flat.off[k + 1]].tobytes() for k in whole])
        rows, owner = np.concatenate([rows[kept], more]), np.concatenate([owner[kept], whole])
        order = np.argsort(owner, kind="stable")
        rows, owner = rows[order], owner[order]
    return rows, owner


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sums of values[bounds[k] : bounds[k + 1]]."""
    summed = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=summed[1:])
    return summed[bounds[1:]] - summed[bounds[:-1]]


def distinct_links(store: WordStore, rows: np.ndarray, owner: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, link, how often it holds it) of each text's different links; ``pairs``: above all links."""
    links, size = store.columns[0].take(rows)
    code = np.repeat(owner, size) * pairs + links
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first] // pairs, code[first] % pairs, np.diff(np.append(first, len(code)))


def scored(known: tuple[np.ndarray, np.ndarray, np.ndarray], links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, best, count) of each link; 0 of those that are not found."""
    codes, count, best = known
    if not len(codes):
        return np.zeros(len(links), bool), np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
    at = np.minimum(np.searchsorted(codes, links), len(codes) - 1)
    found = codes[at] == links
    return found, best[at] * found, count[at] * found


# ---------------------------------------------------------------- Spark

class Scores:
    """The sums over a store's links, by row: how many are best, and their counts; made once for each row and table."""

    last: Scores | None = None

    def __init__(self, key: str, store: WordStore, known: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.key, self.store, self.known, self.epoch, self.sums = key, store, known, -1, np.zeros((0, 2), np.int64)

    @classmethod
    def of(cls, key: str, store: WordStore, held) -> Scores:
        """A worker keeps those of the last broadcast table."""
        if cls.last is None or cls.last.key != key or cls.last.store is not store:
            cls.last = cls(key, store, held.value)
        return cls.last

    def take(self, rows: np.ndarray) -> np.ndarray:
        links = self.store.columns[0]
        if self.epoch != self.store.epoch:
            self.epoch, self.sums = self.store.epoch, self.sums[:0]
        if (at := len(self.sums)) < links.n:
            bounds = links.bounds[at : links.n + 1]
            _, best, count = scored(self.known, links.held[bounds[0] : bounds[-1]])
            self.sums = np.concatenate([self.sums, totals(np.stack([best, count], 1), bounds - bounds[0])])
        return self.sums[rows]


def count_links(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(pair, n, best): in how many documents each id pair overlaps, and whether no other of its first id has more; pair = a * ids of b + b."""
    C.settings(df.sparkSession)
    width = pair_of(path_a, path_b).width

    def run(batches):
        pair, store = pair_of(path_a, path_b), store_of(path_a, path_b)
        pairs = len(pair.bytes_a.size) * pair.width
        held, rows = [], 0
        for batch in batches:
            for part in C.chunks(batch, "text", CHUNK_BYTES):
                links = distinct_links(store, *rows_of(pair, store, part.column(0)), pairs)[1]
                held.append(np.unique(links, return_counts=True))
                rows += len(held[-1][0])
                if rows >= MERGE:
                    held, rows = [merged(held)], 0
                    if len(held[0][0]) >= MERGE // 2:
                        yield table(held.pop())
        if held:
            yield table(merged(held))

    def merged(held):
        code, n = (np.concatenate(x) for x in zip(*held))
        code, at = np.unique(code, return_inverse=True)
        return code, np.bincount(at, n, len(code)).astype(np.int64)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], names=["pair", "n"])

    counts = C.materialize(df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "link-counts")
    first = F.floor(F.col("pair") / width).cast("bigint").alias("a")
    top = counts.groupBy(first).agg(F.max("n").alias("top"))  # a row for each id of the first vocabulary at most
    return C.materialize(counts.select("pair", "n", first).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "link-best")


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """``row`` (struct of ``keep``) and RESULT: counts of tokens, groups and links, links that are their first id's best, sum of the links'
    counts, and ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of both sides by group."""
    spark = df.sparkSession
    counts = count_links(df, path_a, path_b, text)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    least = C.least_count(counts, hot)
    table = counts.where(F.col("n") >= least).orderBy("pair").toArrow()  # ``hot`` rows at most
    known = tuple(table.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best"))
    held, key = spark.sparkContext.broadcast(known), f"{spark.sparkContext.applicationId} {counts.inputFiles()[:1]}"
    rest = counts.where(F.col("n") < least)
    if rest.isEmpty():
        src = src.withColumn("more_best", F.lit(0).cast("bigint")).withColumn("more_count", F.lit(0).cast("bigint"))
    else:
        src = C.materialize(src.withColumn("id", F.monotonically_increasing_id()), "aligned-texts")
        found = src.select("id", "text").mapInArrow(rare_links(path_a, path_b, held), "id bigint, pair bigint, times bigint").join(rest, "pair")
        found = found.groupBy("id").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
        src = src.join(found, "id", "left").select("row", "text", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("more_best", "more_count")))

    def run(batches):
        pair, store = pair_of(path_a, path_b), store_of(path_a, path_b)
        scores = Scores.of(key, store, held)
        for batch in batches:
            for part in C.chunks(batch, "text", CHUNK_BYTES):
                rows, owner = rows_of(pair, store, part.column(1))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                links = totals(store.columns[0].size(rows), bounds)
                numbers = totals(np.concatenate([store.columns[2].take(rows)[0].reshape(len(rows), 4), scores.take(rows)], 1), bounds)
                told, size = store.columns[1].take_bytes(rows)
                off = np.concatenate([[0], np.cumsum(totals(size, bounds))])
                ended = off[1:][off[1:] > off[:-1]] - 1  # the sign after a text's last group
                kept = np.ones(len(told), bool)
                kept[ended] = False
                off -= np.searchsorted(ended, off)
                groups = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(off), pa.py_buffer(told[kept])])
                more = [part.column(k).to_numpy() for k in (2, 3)]
                out = [numbers[:, 1], numbers[:, 2], numbers[:, 3], links, numbers[:, 4] + more[0], numbers[:, 5] + more[1]]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out), groups.cast(pa.string())], names=["row", *(c.split()[0] for c in RESULT.split(", "))])

    return src.mapInArrow(run, T.StructType([src.schema["row"], *T.StructType.fromDDL(RESULT)]))


def rare_links(path_a: str, path_b: str, held):
    """For ``mapInArrow``: (id, pair, times) of the links that the table ``held`` doesn't have."""

    def run(batches):
        pair, store = pair_of(path_a, path_b), store_of(path_a, path_b)
        pairs, known = len(pair.bytes_a.size) * pair.width, held.value
        for batch in batches:
            for part in C.chunks(batch, "text", CHUNK_BYTES):
                text, links, times = distinct_links(store, *rows_of(pair, store, part.column(1)), pairs)
                rare = ~scored(known, links)[0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[rare])), pa.array(links[rare]), pa.array(times[rare])], names=["id", "pair", "times"])

    return run
