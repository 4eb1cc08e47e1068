"""The search by parts against brute force; no query passes through the driver, and a task's memory is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.operators import search as S


def made(n, seed, width=6):
    rng = np.random.default_rng(seed)
    vec = rng.integers(-2, 3, (n, width)).astype(float)  # many ties, some zero vectors
    return [(i, vec[i].tolist() if i % 17 else None, [w for w in ("often", "some", "r1", "r2", f"x{i % 5}") if rng.random() < 0.4]) for i in range(n)]


def brute(qs, rows, k):
    unit = lambda vecs: S._unit(np.array([v or [0.0] * 6 for v in vecs]))
    cos = unit([v for _, v, _ in qs]) @ unit([v for _, v, _ in rows]).T
    out = {}
    for a, (q, _, asked) in enumerate(qs):
        for store in "ab":
            scored = [(round(min(1.0, cos[a, b] + 0.05 * len(set(asked) & set(t))), 9), i) for b, (i, _, t) in enumerate(rows) if "ab"[i % 2] == store]
            out[q, store] = sorted(scored, reverse=True)[:k]
    return out


@pytest.mark.parametrize("block, groups, words, tile", [(32_768, 64, 256, 512), (7, 64, 256, 5), (32_768, 1, 1, 3), (11, 1, 2, 512)])
def test_equals_brute_force_and_spares_the_driver(spark, monkeypatch, block, groups, words, tile):
    for name, value in {"QUERY_BLOCK": block, "GROUPS": groups, "WORDS": words, "TILE": tile, "ROWS": 40}.items():
        monkeypatch.setattr(S, name, value)
    def whole(*_):
        raise AssertionError("the queries are read by the driver")
    monkeypatch.setattr(DataFrame, "toLocalIterator", whole)
    qs, rows = made(40, 1), made(300, 2)
    asked = spark.createDataFrame(qs, "query_id bigint, vec array<double>, tokens array<string>")
    index = spark.createDataFrame(rows, "idx bigint, vec array<float>, tokens array<string>").withColumn("store", F.when(F.col("idx") % 2 == 0, "a").otherwise("b"))
    got = {}
    for r in S.top_candidates(asked, index, 5).orderBy("rank").collect():
        got.setdefault((r.query_id, r.store), []).append((round(r.score, 9), r.idx))
    assert got == brute(qs, rows, 5)


def test_memory_of_many_queries():
    rng = np.random.default_rng(0)
    n = 8192
    asked = S.Asked(np.arange(n), S._unit(rng.standard_normal((n, 64))), pa.array([["a"]] * n), S.TOP, falling=True)
    tracemalloc.start()
    asked.add("a", np.arange(1024)[::-1], S._unit(rng.standard_normal((1024, 64))), pa.array([["a"]] * 1024))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Queries of equal vector and words, without a vector too, share one search and have each their own answer."""
    qs, rows = [(i + 40 * n, v, t) for n in range(3) for i, v, t in made(40, 1)], made(300, 2)
    asked = spark.createDataFrame(qs, "query_id bigint, vec array<double>, tokens array<string>")
    index = spark.createDataFrame(rows, "idx bigint, vec array<float>, tokens array<string>").withColumn("store", F.when(F.col("idx") % 2 == 0, "a").otherwise("b"))
    met, meet = [], S.meet
    monkeypatch.setattr(S, "meet", lambda asked, rows, n, *rest: met.append(n) or meet(asked, rows, n, *rest))
    got = {}
    for r in S.top_candidates(asked, index, 5).orderBy("rank").collect():
        got.setdefault((r.query_id, r.store), []).append((round(r.score, 9), r.idx))
    assert met[0] <= 40 and got == brute(qs, rows, 5)
