import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from priceloom.llm import bpe
from tests.llm.docs import COLLIDING, TEXTS, frame

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
RND = random.Random(9)
ODD = ["it's we'll they'd I'm", "12345 67 ½ ٣", "a b c 　 d", "x" * 700, "  \n\n  \t x  ", "naïve façade 你好世界 हिन्दी", "".join(chr(RND.choice([32, 97, 98, 228, 0x4E2D, 0x1F600, 10, 39, 0x301])) for _ in range(400)), "\x00\x1c\x85 end", "é ﻿"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("hot, long", [(bpe.HOT, bpe.LONG), (20, 40), (0, 9)])
def test_equals_library_and_round_trips(spark, ranks, library, hot, long):
    texts = TEXTS + ODD
    df = frame(spark, texts)
    got = bpe.encode(df, ranks, P.PATTERN, keep=["doc_id"], hot=hot, long=long)
    rows = {r.doc_id: r for r in bpe.decode(got.select("row.doc_id", "ids"), ranks).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode_ordinary(t or ""), (i, t)
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_heap_equals_library(ranks, library):
    for _ in range(50):
        w = "".join(RND.choice("abcdeinst") for _ in range(RND.randrange(1, 400)))
        assert bpe.merge_long(w.encode(), ranks) == library._encode_single_piece(w.encode()) or ranks.get(w.encode()) is not None


def test_empty_table_and_extra_columns(spark, ranks):
    assert bpe.encode(frame(spark).limit(0), ranks, P.PATTERN).count() == 0
    df = frame(spark, ["same", "same", None])
    twice = df.union(df).withColumn("doc_id", F.lit(None).cast("bigint"))
    out = bpe.encode(twice, ranks, P.PATTERN)
    assert out.count() == 6 and out.select("row.*").columns == df.columns
    assert hashlib.sha256(b"").hexdigest() == out.where("row.text IS NULL").select(F.sha2(F.array_join("ids", " "), 256)).first()[0]


def test_round_trip_equals_encode_and_decode(spark, ranks):
    df = frame(spark, TEXTS + ODD)
    once = {r.row.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.round_trip(df, ranks, P.PATTERN, keep=["doc_id"], hot=30).collect()}
    twice = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, ranks, P.PATTERN, keep=["doc_id"]).select("row.doc_id", "ids"), ranks).collect()}
    assert once == twice and len(once) == len(TEXTS + ODD)
    assert bpe.decode(spark.createDataFrame([(1, None)], "k int, ids array<int>"), ranks).first().decoded == b""
    assert bpe.round_trip(df.limit(0), {}, P.PATTERN).count() == 0


@pytest.mark.parametrize("hot", [bpe.HOT, 1, 0])
def test_words_of_one_hash_differ(spark, ranks, library, hot):
    texts = [*COLLIDING, " ".join(COLLIDING), COLLIDING[1]]
    rows = {r.row.doc_id: r for r in bpe.round_trip(frame(spark, texts), ranks, P.PATTERN, keep=["doc_id"], hot=hot).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode_ordinary(t) and bytes(rows[i].decoded) == t.encode()
