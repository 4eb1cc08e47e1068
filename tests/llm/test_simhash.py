import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from priceloom.llm import simhash as S
from priceloom.llm.components import components
from tests.llm.docs import PROSE, TEXTS, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_equals_brute_force(spark):
    words = PROSE.split()
    texts = TEXTS + [" ".join(words[:i] + ["changed"] + words[i:]) for i in range(0, 60, 4)] + ["alpha beta gamma"] * 3
    fp = [brute_fp(t) for t in texts]
    want = groups([(i, j) for j in range(len(fp)) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= 2], range(len(fp)))
    got = {r.id: (r.fp % 2**64, r.component) for r in S.near_dedup(frame(spark, texts)).collect()}
    assert got == {i: (fp[i], want[i]) for i in range(len(fp))}


def test_same_hash_as_spark(spark):
    r = spark.sql("SELECT xxhash64('alpha beta gamma') AS h").first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest(b"alpha beta gamma", 42)


def test_no_link_is_lost(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:60]:
        for _ in range(12):
            x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    far = np.bitwise_count(a[:, None] ^ a[None, :])
    want = groups([(int(i), int(j)) for i, j in zip(*np.where(far <= 2)) if i < j], range(len(fps)))
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp bigint").repartition(4)
    at = {int(x): i for i, x in enumerate(a.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in S.links(df).collect()]
    assert groups(pairs, range(len(fps))) == want
    label = {at[r.node]: at[r.label] for r in components(S.links(df)).collect()}
    sizes = lambda g: sorted(len([1 for y in g.values() if y == x]) for x in set(g.values()))
    assert sizes(label) == [n for n in sizes(want) if n > 1]


def test_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint").orderBy(F.rand(1))
    assert {(r.node, r.label) for r in components(df).collect()} == {(i, 0) for i in range(n + 1)}


def test_empty_and_null_ids(spark):
    assert S.near_dedup(frame(spark).limit(0)).count() == 0
    df = frame(spark, ["alpha beta gamma delta"] * 3 + ["other words here now"]).withColumn("doc_id", F.when(F.col("doc_id").isin(1, 2), F.col("doc_id")))
    assert sorted(((r.id, r.component) for r in S.near_dedup(df).collect()), key=str) == sorted([(None, 1), (1, 1), (2, 1), (None, None)], key=str)
