import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from priceloom.llm import id_files as I
from priceloom.llm.word_store import WordStore
from tests.llm.docs import LONG, TEXTS, frame

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("word_bpe_49k.json")
MORE = ["é áb ́x", "Å ẛ̣", "ΑΣ ΣΑΣ. İI ı", "a b　c d \u0085e", "it's we'll 'S 12 3", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "\x00 \x1c\x1d a"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def want(rows, special=True):
    t, out, start = tokenizer(), [], 0
    t.encode_special_tokens = not special
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r)[1:] for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("bits, block, file_ids", [(True, I.BLOCK, I.FILE_IDS), (False, 1000, 3000), (True, 7, 1), (False, 8, 50)])
def test_round_trip(spark, bits, block, file_ids):
    texts = TEXTS + MORE
    df = frame(spark, texts)
    assert got(I.round_trip(df, MODEL, bits=bits, block=block, file_ids=file_ids)) == want(list(enumerate(texts)))


def test_plain_special_tokens(spark):
    df = frame(spark, MORE)
    assert got(I.round_trip(df, MODEL, special=False)) == want(list(enumerate(MORE)), special=False)
    assert want(list(enumerate(MORE)), special=False) != want(list(enumerate(MORE)))


def test_null_and_repeated_document_ids(spark):
    rows = [(None, "first of all"), (-3, "b"), (2, "same"), (2, "same"), (2, "same"), (2**40, LONG)]
    df = spark.createDataFrame([(*r, "clash") for r in rows[::-1]], "doc_id bigint, text string, id string").repartition(3)
    assert got(I.round_trip(df, MODEL)) == want(rows)
    tied = spark.createDataFrame([(1, "a b"), (1, "c"), (0, "x")] * 20, "doc_id bigint, text string").repartition(5)
    out = got(I.round_trip(tied, MODEL))
    assert [r[0] for r in out] == [0] * 20 + [1] * 40 and all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:]))


def test_empty_table(spark):
    df = frame(spark).where("doc_id < 0")
    assert I.round_trip(df, MODEL).collect() == []


def test_ranges_of_ids(spark):
    t = tokenizer()
    files = I.write_files(frame(spark), MODEL, block=50, file_ids=400)
    assert files.count() > 3
    whole = [i for text in TEXTS for i in [*t.encode(text or "", add_special_tokens=False).ids, 1]]
    for start, stop in [(0, len(whole)), (0, 1), (49, 51), (390, 1900), (len(whole) - 1, len(whole) + 5), (7, 7)]:
        assert I.read_range(spark, files, start, stop).tolist() == whole[start:stop]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.booleans(), st.integers(1, 20))
def test_file_holds_any_ids(docs, bits, block):
    held = io.BytesIO()
    w = I.IdWriter(held, bits, block)
    for k, ids in enumerate(docs):
        w.add([k if k % 3 else None], np.array([len(ids)]), np.array(ids, np.uint32))
    w.close()
    f = I.IdFile(held)
    assert [f.document(k).tolist() for k in range(len(docs))] == docs
    assert f.doc_ids.to_pylist() == [k if k % 3 else None for k in range(len(docs))]
    assert f.checksums() == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in docs]


def test_damaged_file():
    held = io.BytesIO()
    w = I.IdWriter(held)
    w.add([1], np.array([3]), np.array([5, 6, 7], np.uint32))
    w.close()
    raw = held.getvalue()
    for bad in (raw[:-1], raw[:10], b"", raw[:-8] + b"IDPLANE2"):
        with pytest.raises(ValueError):
            I.IdFile(io.BytesIO(bad))


def test_word_store_forgets_and_makes_again():
    import pyarrow as pa

    made = []

    def make(words):
        made.append(len(words))
        return [(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))]

    store = WordStore(make, [np.uint8], words=4)
    for words in (["a", "bb", "a"], ["a", "ccc", ""], ["a", "d"], ["d", "a" * 9000]):
        values, sizes = store.columns[0].take(store.rows(pa.array(words, pa.large_binary())))
        assert bytes(values) == "".join(words).encode() and sizes.tolist() == [len(w) for w in words]
    assert made == [2, 2, 1, 1]  # "a" was met twice, so it is kept
