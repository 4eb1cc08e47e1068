"""As-of and interval joins against a search through all rows."""

import datetime as dt
import random

import pytest

from priceloom.operators import asof as A

RND = random.Random(9)
T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
LEFT = [(i, RND.choice([1, 1, 1, 2, 3, None]), None if i % 37 == 0 else at(RND.randrange(300))) for i in range(400)]
RIGHT = [(RND.choice([1, 1, 1, 2, 4, None]), None if i % 29 == 0 else at(RND.randrange(300)), float(i), None if i % 5 else f"s{i}") for i in range(150)]


def frames(spark):
    return spark.createDataFrame(LEFT, "id int, sku int, ts timestamp").repartition(3), spark.createDataFrame(RIGHT, "sku int, seen timestamp, price double, shop string").repartition(2)


def brute(strict):
    out = []
    for i, k, t in LEFT:
        held = [r for r in RIGHT if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        best = max(held, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        out.append((i, k, t, *best[1:]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [A.MOST, 20, 1])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, most, strict):
    left, right = frames(spark)
    got = A.asof_join(left, right, "sku", "ts", "seen", most=most, strict=strict)
    assert got.columns == ["id", "sku", "ts", "ts_right", "price", "shop"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(strict)


def test_asof_of_other_times(spark):
    left, right = frames(spark)
    for kind in ("timestamp_ntz", "bigint", "double"):
        cast = lambda df, c: df.withColumn(c, df[c].cast("timestamp").cast("timestamp_ntz") if kind == "timestamp_ntz" else df[c].cast("bigint").cast(kind))  # noqa: E731, B023
        got = A.asof_join(cast(left, "ts"), cast(right, "seen"), "sku", "ts", "seen", most=20).collect()
        assert sorted(((r.id, r.price) for r in got), key=repr) == sorted(((r[0], r[4]) for r in brute(False)), key=repr)


def test_asof_of_nothing(spark):
    left, right = frames(spark)
    assert A.asof_join(left.limit(0), right, "sku", "ts", "seen").count() == 0
    assert {r.price for r in A.asof_join(left, right.limit(0), "sku", "ts", "seen").collect()} == {None}
    with pytest.raises(ValueError):
        A.asof_join(left, right.withColumnRenamed("price", "id"), "sku", "ts", "seen")


def test_no_pairs_are_formed(spark):
    left, right = frames(spark)
    plan = A.asof_join(left, right, "sku", "ts", "seen")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_intervals(spark):
    left, _ = frames(spark)
    spans = [(j, RND.choice([1, 2, 3, None]), at(s := RND.randrange(300)), at(s + RND.choice([0, 1, 7, 200]))) for j in range(80)]
    iv = spark.createDataFrame(spans, "iv int, sku int, begun timestamp, ended timestamp")
    want = sorted((i, j) for i, k, t in LEFT for j, k2, b, e in spans if None not in (k, t) and k == k2 and b <= t < e)
    for width in (0.5, 10, 1000):
        assert sorted((r.id, r.iv) for r in A.interval_join(left, iv, "sku", "ts", "begun", "ended", width).collect()) == want
    assert "BroadcastNestedLoopJoin" not in A.interval_join(left, iv, "sku", "ts", "begun", "ended", 10)._jdf.queryExecution().executedPlan().toString()
