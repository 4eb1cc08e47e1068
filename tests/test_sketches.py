"""Sketches of runs against exact counts and ranks, at three sizes; merging equals sketching all at once."""

import bisect

import pytest
from pyspark.sql import functions as F

from priceloom.operators import sketches as S

QUANTILES = [0.01, 0.25, 0.5, 0.75, 0.99]


def rows(spark, n):
    return spark.range(n).select((F.col("id") % 7).alias("run"), (F.xxhash64("id") % F.lit(max(1, n // 3))).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("price"))


@pytest.mark.parametrize("n", [200, 20_000, 500_000])
def test_errors_are_bounded(spark, tmp_path, n):
    df = rows(spark, n)
    for run in range(7):  # a run at a time
        S.append(S.sketch(df.where(F.col("run") == run), "run", "key", "price"), str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    assert stored.count() == min(n, 7)
    whole = S.read(S.merge(stored), QUANTILES).first()
    exact = df.agg(F.countDistinct("key")).first()[0]
    assert whole.n == n and abs(whole.distinct / exact - 1) < 0.03
    prices = sorted(r.price for r in df.select("price").collect())
    for q, told in zip(QUANTILES, whole.quantiles):
        low, high = bisect.bisect_left(prices, told) / n, bisect.bisect_right(prices, told) / n
        assert low - 0.01 <= q <= high + 0.01
    apart = {r.run: r.n for r in S.read(stored, [0.5]).collect()}
    assert sum(apart.values()) == n


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "x", 3.0), ("b", None, None)], "run string, key string, price double")
    got = {r.run: (r.n, r.distinct, r.quantiles) for r in S.read(S.sketch(df, "run", "key", "price"), [0.5]).collect()}
    assert got == {"a": (2, 1, [3.0]), "b": (1, 0, None)}
    assert S.read(S.merge(S.sketch(df.limit(0), "run", "key", "price"), "run"), [0.5]).count() == 0
