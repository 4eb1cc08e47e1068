"""The trained encoder against weights and cosines computed one by one."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.operators import embed as M
from priceloom.operators import search as S
from priceloom.plans import catalogue as C

TITLES = ["Tornillo Yeso-cartón 6x1", "tornillo techo zinc", "perno", "a", "", None, "perno perno  PERNO", "clavo 2\" 50mm caja 100 un"]


def buckets_of(norm):
    out = []
    for w in dict.fromkeys(norm.split()):
        m = f"<{w}>"
        out += [m] + [m[i : i + n] for n in M.GRAMS for i in range(len(m) - n + 1)]
    return [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % M.BUCKETS for g in out]


def weighted(lists):
    n, total = Counter(b for x in lists for b in set(x)), len(lists)
    rows = []
    for x in lists:
        row = {b: (1 + math.log(f)) * (math.log((1 + total) / (1 + n[b])) + 1) for b, f in Counter(x).items()}
        norm = math.sqrt(sum(v * v for v in row.values()))
        rows.append({b: v / norm for b, v in row.items()})
    return rows


def test_features(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", X.normalize(F.col("t")).alias("norm"), M.features(F.col("t")).alias("f"))
    for r in df.collect():
        assert sorted(r.f) == sorted(buckets_of(r.norm or ""))


def test_full_rank_keeps_every_cosine(spark):
    texts = [f"{C.KINDS[i % 6]} {C.WORDS[i % 21]} {i % 5}mm" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = M.fit(df, rank=10_000, sweeps=2)
    got = np.array([r.v for r in M.encode(df, model, vector="v").collect()])
    rows = weighted([buckets_of(r.n) for r in df.select(X.normalize(F.col("text")).alias("n")).collect()])
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in rows] for a in rows]
    unit = got / np.linalg.norm(got, axis=1)[:, None]
    assert np.allclose(unit @ unit.T, want, atol=1e-4)


def test_nulls_unknown_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "text string")
    model = M.fit(df, rank=4)
    asked = spark.createDataFrame([(None,), ("",), ("zzqqyy",), ("perno",)], "t string")
    v = [r.v for r in M.encode(asked, model, "t", "v").collect()]
    assert [any(x) for x in v] == [False, False, False, True] and all(len(x) == 4 for x in v)
    none = M.fit(df.limit(0))
    assert none.count() == 0 and [r.v for r in M.encode(asked, none, "t", "v").collect()] == [[]] * 4


@pytest.fixture(scope="module")
def titles(spark):
    return C.products(spark.read.parquet("/root/testdata/sf0.01/part.parquet")).select("id", F.col("titulo").alias("text")).cache()


def test_recall_of_the_exact_top(spark, titles, tmp_path):
    """The best 15 of the index are among the exact weighted cosine's best 15 (or tie with its last) for at least nine in ten."""
    M.write(M.fit(titles), str(tmp_path / "model"))
    model = M.read(spark, str(tmp_path / "model"))
    assert model.count() <= M.BUCKETS
    coded = M.encode(titles, model)
    index = coded.select(F.lit("a").alias("store"), F.col("id").alias("idx"), "vec", F.array().cast("array<string>").alias("tokens"))
    found = S.top_candidates(S.queries(coded.where("id % 100 = 0").select(F.col("id").alias("query_id"), "text", "vec")), index)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.idx)
    norm = {r.id: r.n for r in titles.select("id", X.normalize(F.col("text")).alias("n")).collect()}
    ids = sorted(norm)
    rows = dict(zip(ids, weighted([buckets_of(norm[i]) for i in ids])))
    kept = []
    for q, best in got.items():
        exact = {i: sum(v * rows[i].get(b, 0) for b, v in rows[q].items()) for i in ids}
        least = sorted(exact.values())[-15]
        kept.append(np.mean([exact[i] >= least - 1e-9 for i in best]))
    assert len(got) == 20 and all(len(b) == 15 for b in got.values())
    print("recall", np.mean(kept))
    assert np.mean(kept) >= 0.9


def test_answers_follow_from_the_encoder(spark):
    """Every query has one answer a store, matched by the rule and priced by the piece where it is a match."""
    import __spark_entry__ as entry

    rows = entry.queries()["q_trained_answers"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.query_id, r.store) for r in rows) == [(q, s) for q in (0, 100) for s in "ab"]
    for r in rows:
        assert r.is_match == (r.similarity >= 0.7 and r.number_match == 1) and (r.unit_price is not None) == r.is_match


def test_features_of_words_that_are_forgotten_and_of_halved_blocks(monkeypatch):
    """Neither the words that a task still knows nor the size of its blocks change a weight."""
    rng = np.random.default_rng(0)
    texts = [" ".join(dict.fromkeys("".join(rng.choice(list("abñ9"), rng.integers(1, 6))) for _ in range(rng.integers(0, 9)))) for _ in range(200)]
    lists, idf = pa.array([t.split() for t in texts], pa.list_(pa.string())), rng.random(M.BUCKETS) + 1

    def weights():
        known, out = M.Known(M.BUCKETS), []
        for batch in (lists[:70], lists[70:]):
            for rows, row, at in known.blocks(batch):
                w = M.Weights(rows, row, at, idf)
                out += [dict(zip(w.met[b > 0].tolist(), b[b > 0].tolist())) for b in w.block]
        return out

    want = []
    for t in texts:
        row = {b: (1 + math.log(f)) * idf[b] for b, f in Counter(buckets_of(t)).items()}
        norm = math.sqrt(sum(v * v for v in row.values()))
        want.append({b: pytest.approx(v / norm) for b, v in row.items()})
    for known, cells in ((M.KNOWN, M.CELLS), (20, M.CELLS), (M.KNOWN, 50)):
        monkeypatch.setattr(M, "KNOWN", known)
        monkeypatch.setattr(M, "CELLS", cells)
        assert weights() == want


def test_one_file_is_dealt_to_many_tasks(spark, monkeypatch):
    """The table of parts is one small file, which was one task from text to vector."""
    import __spark_entry__ as entry

    class Enough(Exception):
        pass

    def fit(texts, text):
        raise Enough(texts.rdd.getNumPartitions())

    monkeypatch.setattr(M, "fit", fit)
    with pytest.raises(Enough) as found:
        entry.queries()["q_trained_answers"](spark, "/root/testdata/sf0.01")
    assert found.value.args[0] > 1
