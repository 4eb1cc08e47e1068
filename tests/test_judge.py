"""The learned judge agrees with the rule that labelled its pairs, but near the cut."""

from pyspark.sql import functions as F

from priceloom.operators import judge as J
from priceloom.operators import search as S

BAND = 0.02


def pairs(spark, n=3000):
    df = spark.range(n).select("id", (F.col("id") * 37 % 1000 / 1000).alias("similitud_texto"), (F.floor(F.col("id") / 7) % 2).cast("int").alias("misma_dimension"))
    return df.withColumn("es_match", S.judge(F.col("similitud_texto"), F.col("misma_dimension")).cast("int"))


def test_agrees_and_survives_save_and_load(spark, tmp_path):
    J.save(J.fit(pairs(spark), folds=2, depths=(2,)), str(tmp_path / "judge"))
    model = J.load(str(tmp_path / "judge"))
    rows = J.judge(pairs(spark, 2000), model).collect()
    assert len(rows) == 2000
    for r in rows:
        if abs(r.similitud_texto - S.CUT) > BAND:
            assert r.is_match == (r.es_match == 1), r
    assert all(r.match_probability > 0.5 for r in rows if r.is_match) and all(0 <= r.match_probability <= 1 for r in rows)


def test_many_equal_pairs_hide_no_others(spark):
    """2000 different pairs, 40 times each, and fewer rows to learn from than there are."""
    alike = pairs(spark, 2000).crossJoin(spark.range(40).select(F.col("id").alias("copy")))
    told = J.judge(pairs(spark, 2000), J.fit(alike, rows=1000, folds=2, depths=(2,)))
    assert told.where((F.abs(F.col("similitud_texto") - S.CUT) > BAND) & (F.col("is_match") != (F.col("es_match") == 1))).count() == 0


def test_probabilities_are_calibrated(spark):
    """Labels with noise: of pairs that are told p, about a share p is a match."""
    noisy = pairs(spark).withColumn("es_match", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, 1 - F.col("es_match")).otherwise(F.col("es_match")))
    told = J.judge(noisy, J.fit(noisy, folds=2, depths=(2,)))
    for r in told.groupBy("is_match").agg(F.avg("match_probability").alias("p"), F.avg("es_match").alias("share")).collect():
        assert abs(r.p - r.share) < 0.08, r
