import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.llm import quality_classifier as Q
from tests.llm.docs import LONG, PROSE, TEXTS, frame

GOOD, BAD = PROSE, "BUY!! NOW!! ### $$$ BUY!! NOW!! ### $$$ " * 20


def site(spark, n=120):
    """Host a: all good; host b: all bad; host c: one document."""
    texts, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        texts.append((GOOD if good else BAD) + f" tail {i}")
        if i % 3 == 0:
            labels.append((i, int(good)))
    df = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") == n - 1, "c").when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    return df, spark.createDataFrame(labels, "doc_id bigint, quality int")


def run(df, labels, **options):
    return Q.classify(df, labels, F.col("source"), F.col("lang"), **options)


def test_separates_and_shrinks(spark):
    df, labels = site(spark)
    rows = {r.row.doc_id: r for r in run(df, labels).collect()}
    assert len(rows) == 120 and all(r.good == (i % 2 == 0) for i, r in rows.items())
    # the lone document of host c leaves no other vote: its prior is its host's shrunk rate, nearer the middle
    assert rows[1].host_rate < rows[119].host_rate < rows[0].host_rate
    assert rows[0].row.kept == 1.5 and all(0 <= r.quality <= 1 for r in rows.values())


def test_posterior_follows_the_formulas(spark):
    df, labels = site(spark)
    rows = [r for r in run(df, labels).collect()]
    for r in rows:
        z = r.evidence + np.log(r.path_rate / (1 - r.path_rate))
        assert r.quality == pytest.approx(1 / (1 + np.exp(-z)))


def test_fit_finds_the_ratio():
    rnd = np.random.default_rng(1)
    y = (rnd.random(6000) < 0.7).astype(float)
    x = np.stack([rnd.normal(y, 1), rnd.normal(0, 3, 6000)], 1)
    w, b = Q.fit(x, y)  # true log-likelihood ratio: x - 1/2
    assert abs(w[0] - 1) < 0.15 and abs(w[1]) < 0.05 and abs(b + 0.5) < 0.15
    assert Q.fit(np.zeros((0, 2)), np.zeros(0))[1] == 0


def test_awkward_rows_and_empty_tables(spark):
    df = frame(spark, [*TEXTS, LONG]).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    df = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (99, 0), (11, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    assert run(df, labels).count() == 2 * (len(TEXTS) + 1)
    assert run(df, labels.limit(0)).where("quality IS NULL").count() == 0
    assert run(df.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where("doc_id % 3 = 0")
    got = run(docs, labels.where("doc_id % 3 <> 0"), keep=["doc_id"]).select("row.doc_id", "good").join(test, "doc_id")
    assert got.where(F.col("good") == (F.col("quality") == 1)).count() >= 0.9 * got.count() > 0


def brute_rates(rows, labels):
    """Host and path rates from their definition, with every document's own vote left out."""
    rate = min(max(np.mean([y for _, y in labels]), 1e-3), 1 - 1e-3)
    known = dict(labels)
    vote = {r.row.doc_id: known.get(r.row.doc_id, 1 / (1 + np.exp(-(r.evidence + np.log(rate / (1 - rate)))))) for r in rows}
    host_of, path_of = {r.row.doc_id: r.row.source for r in rows}, {r.row.doc_id: (r.row.source, r.row.lang) for r in rows}

    def sites(of):
        out = {}
        for i, s in of.items():
            out.setdefault(s, []).append(vote[i])
        return out

    hosts, paths = sites(host_of), sites(path_of)
    overall = min(max(np.mean(list(vote.values())), 1e-3), 1 - 1e-3)

    def strength(groups, parent):
        some = {s: v for s, v in groups.items() if len(v) >= 2}
        n = sum(map(len, some.values()))
        spread = sum(len(v) * (np.mean(v) - parent(s)) ** 2 for s, v in some.items())
        chance = sum(parent(s) * (1 - parent(s)) for s in some)
        whole = sum(len(v) * parent(s) * (1 - parent(s)) for s, v in some.items())
        between = (spread - chance) / n
        return min(max(whole / n / between - 1 if between > 0 else Q.STRENGTH[1], Q.STRENGTH[0]), Q.STRENGTH[1])

    k_host = strength(hosts, lambda s: overall)
    rates = {s: (sum(v) + k_host * overall) / (len(v) + k_host) for s, v in hosts.items()}
    k_path = strength(paths, lambda s: rates[s[0]])
    out = {}
    for i in vote:
        h, p = hosts[host_of[i]], paths[path_of[i]]
        top = min(max((sum(vote.values()) - vote[i]) / (len(vote) - 1), 1e-3), 1 - 1e-3)
        host = (max(sum(h) - vote[i], 0) + k_host * top) / (len(h) - 1 + k_host)
        out[i] = host, min(max((max(sum(p) - vote[i], 0) + k_path * host) / (len(p) - 1 + k_path), 1e-4), 1 - 1e-4)
    return out


def mixed_sites(spark):
    df, labels = site(spark, 90)
    df = df.withColumn("source", F.concat(F.lit("h"), (F.col("doc_id") * F.col("doc_id") % 7).cast("string"))).withColumn("lang", F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")))
    return df, labels


def test_rates_equal_brute_force(spark):
    df, labels = mixed_sites(spark)
    rows = run(df, labels).collect()
    want = brute_rates(rows, [tuple(r) for r in labels.collect()])
    assert {r.row.doc_id: (r.host_rate, r.path_rate) for r in rows} == {i: pytest.approx(x, rel=1e-6) for i, x in want.items()}


def test_own_label_leaves_the_site_rates_alone(spark, monkeypatch):
    monkeypatch.setattr(Q, "TRAIN_ROWS", 0)  # no evidence, so that only votes differ
    monkeypatch.setattr(Q, "STRENGTH", (5.0, 5.0))
    df, _ = mixed_sites(spark)
    rates = []
    for mine in (0, 1):
        labels = spark.createDataFrame([(i, mine if i == 0 else i * i % 3 % 2) for i in range(90)], "doc_id bigint, quality int")
        rates.append(tuple(run(df, labels).where("row.doc_id = 0").select("host_rate", "path_rate").first()))
    assert rates[0] == pytest.approx(rates[1], rel=1e-12)


def test_columns_of_internal_names_survive(spark):
    df, labels = site(spark, 12)
    odd = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["__host", "__path", "host", "path", "x", "key", "id", "evidence", "vote"])])
    rows = run(odd, labels).collect()
    assert len(rows) == 12 and rows[0].row["__host"] == 0 and rows[0].row.vote == 8
