"""Operator 13: spelling variants by anagram hashing.

Words: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; of a run whose crc32 of
``<id>:<run>`` is a multiple of ``EVERY``, one letter is left out (see ``variants``).  A task counts the different words of
some megabytes of text with numpy and merges these counts before they are shuffled.

Near words, in the JVM
1. A word's anagram key is the sum of its letters' codes to the fifth power, an integer that doesn't depend on their order.
2. Each word stands under its key and under its key less each of its different letters' values.  Joining on these finds
   all pairs whose keys differ by one letter's value (an addition or a removal) or by the difference of two (an exchange),
   each pair once.
3. The letters' order is verified: an edit distance of one.
4. Keys that more than ``CROWD`` words share (anagrams of each other but for a letter) are dealt further by what is left of
   the word without that letter, in order, so a crowd is never paired out; the verification is the same.

Every word has its number of near words, the most frequent of them (``form``, if frequent enough) and ``root``, the end of the
chain of forms, found by pointer jumping: counts double along a chain, so its length is logarithmic.

Null and empty texts hold no words.  A null id reads as an empty one.  A very long text is counted as a whole, a very long
word is a word.  Ties between near words go to the smallest in code-point order.  Repeated rows count again.  An empty table
gives an empty table.  Of further columns nothing is read, so no name can clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS, LEAST, EVERY, RATIO, CROWD = 5, 3, 97, 2, 64
#: Bytes of text that are counted at once, words and bytes of words that a task merges at once, and the longest run whose checksums are shifted by table.
CHUNK_BYTES, MERGE, MERGE_BYTES, SHORT = 1 << 22, 1 << 20, 1 << 26, 48

IS_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: crc32 of one more zero byte, by the lowest byte so far.
STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


# ---------------------------------------------------------------- counting


def checksums(prefixes: list[bytes], owner: np.ndarray, word: np.ndarray, words: list[bytes]) -> np.ndarray:
    """crc32 of prefixes[owner] + words[word] for each pair: checksums are linear, so both parts are computed once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    start = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    shifted = np.empty((SHORT + 1, len(prefixes)), np.uint32)
    shifted[0] = start
    for k in range(SHORT):
        shifted[k + 1] = STEP[shifted[k] & 255] ^ (shifted[k] >> np.uint32(8))
    out = own[word] ^ shifted[np.minimum(size, SHORT)[word], owner]
    for k in np.flatnonzero(size[word] > SHORT):
        out[k] = zlib.crc32(words[word[k]], int(start[owner[k]]))
    return out


def chunk_counts(ids: pa.Array, texts: pa.Array, every: int, letters: int) -> tuple[pa.Array, np.ndarray]:
    """(words, how often each occurs) of a chunk; a word may come twice."""
    flat = C.Flat(texts)
    latin = flat.data == 0xC3  # leads U+00C0 to U+00FF, and nothing else
    inside = IS_LETTER[flat.data] | latin
    inside[1:] |= latin[:-1]
    starts, ends, owner = flat.runs(inside)
    held = C.ASCII_LOWER[flat.data[inside]]
    code, different = C.numbered(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(held)]))
    words = different.to_pylist()
    points = np.fromiter((len(w) - w.count(b"\xc3") for w in words), np.int64, len(words))
    h = checksums([f"{i or ''}:".encode() for i in ids.to_pylist()], owner, code, words)
    hit = h % every == 0 if every else np.zeros(len(h), bool)
    n = C.sums_by(code[~hit], len(words))
    cut: Counter[str] = Counter()
    for k, at in zip(code[hit], h[hit] % points[code[hit]]):
        word = words[k].decode()
        cut[word[:at] + word[at + 1 :]] += 1
    take = np.flatnonzero((n > 0) & (points >= letters))
    cut = {w: c for w, c in cut.items() if len(w) >= letters}
    return pa.concat_arrays([different.take(pa.array(take)).cast(pa.large_string()), pa.array(cut, pa.large_string())]), np.concatenate([n[take], np.fromiter(cut.values(), np.int64, len(cut))])


def count_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, letters: int = LETTERS) -> DataFrame:
    """(word, n): the words of at least ``letters`` letters of all texts."""
    C.settings(df.sparkSession)
    src = df.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            for part in C.chunks(batch, "text", CHUNK_BYTES):
                words, n = chunk_counts(part.column(0), part.column(1), every, letters)
                held.append(pa.table({"word": words, "n": n}))
                rows, size = rows + len(words), size + words.nbytes
                if rows >= MERGE or size >= MERGE_BYTES:
                    held, rows, size = [merged(held)], 0, 0
                    if len(held[0]) >= MERGE // 2 or held[0].nbytes >= MERGE_BYTES // 2:
                        yield from handed_on(held.pop())
        if held:
            yield from handed_on(merged(held))

    def merged(held: list[pa.Table]) -> pa.Table:
        """Of the same types as its parts, as it may be one of them next time."""
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def handed_on(counts: pa.Table):
        for batch in counts.to_batches(1 << 16):
            for part in C.chunks(batch, "word", CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1)], names=["word", "n"])

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- near words


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    return code * code * code * code * code


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def anagram_key(word: Column) -> Column:
    return F.aggregate(letters_of(word), F.lit(0).cast("bigint"), lambda s, c: s + letter_value(c))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n) of all pairs that are one inserted, deleted or replaced letter apart, both ways round."""
    # the letter that a row's key goes without; none for the word's own key
    less = F.concat(F.array(F.lit("")), F.array_distinct(letters_of(F.col("word"))))
    keyed = words.withColumn("whole", anagram_key(F.col("word"))).withColumn("less", F.explode(less))
    keyed = C.materialize(keyed.select((F.col("whole") - F.when(F.col("less") == "", F.lit(0)).otherwise(letter_value(F.col("less")))).alias("key"), "less", "word", "n"), "spelling-keys")
    crowded = C.materialize(keyed.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowded")), "spelling-crowds")
    told = C.materialize(keyed.join(crowded, "key", "left"), "spelling-told") if not crowded.isEmpty() else keyed.withColumn("crowded", F.lit(None).cast("boolean"))
    left, right = told.where("crowded IS NULL"), told.where("crowded IS NULL")
    order = F.when(F.col("less") == "", F.array("word")).otherwise(
        F.transform(F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("less")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    )
    dealt = told.where("crowded").withColumn("rest", F.explode(F.array_distinct(order)))

    def pairs(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
        edit = ((F.col("a.less") != "") | (F.col("b.less") != "")) & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)
        for c in same:
            edit = c & edit
        return a.join(b, edit).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))

    return pairs(left, right, "key").union(pairs(dealt, dealt, "key", "rest").distinct())


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): where the chain of ``forms`` (word, form) ends; counts double along it, up to ``most``."""
    found = C.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    length = max(1, math.ceil(math.log2(max(2, most))))
    for _ in range(math.ceil(math.log2(length)) if length > 1 else 0):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        found = C.materialize(found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        if found.where("moved").isEmpty():
            break
        found = found.select("word", "root")
    return found.select("word", "root")


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, letters: int = LETTERS, least: int = LEAST, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word with ``least`` occurrences.

    ``every``: of a run with crc32(``<id>:<run>``) = h divisible by it, the letter h modulo its length is left out (0: none).
    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's.
    """
    words = C.materialize(count_words(df, doc_id, text, every, letters).where(F.col("n") >= least), "spelling-words")
    pairs = near_pairs(words, crowd)
    rows = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    rows = rows.unionByName(pairs.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = C.materialize(found.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-near")
    most = found.agg(F.max("form_n").alias("n")).first().n or 1
    ends = roots(found.where("form IS NOT NULL"), most)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
