"""Sessions of a stream equal those of the table; rows that come too late are counted."""

import datetime as dt
import random

from pyspark.sql import functions as F

from priceloom.streaming import sessions as S

RND = random.Random(6)
T0 = dt.datetime(2024, 1, 1)
ROWS = sorted(((RND.randrange(4), T0 + dt.timedelta(minutes=RND.randrange(6000)), float(i)) for i in range(200)), key=lambda r: r[1])
SCHEMA = "k int, ts timestamp, v double"


def brute(rows, gap=30):
    out = []
    for k in {r[0] for r in rows}:
        held: list[list] = []
        for _, t, v in sorted(r for r in rows if r[0] == k):
            if held and t <= held[-1][-1][0] + dt.timedelta(minutes=gap):
                held[-1].append((t, v))
            else:
                held.append([(t, v)])
        out += [(k, h[0][0], h[-1][0] + dt.timedelta(minutes=gap), len(h), sum(v for _, v in h)) for h in held]
    return sorted(out)


def found(df):
    return S.sessions(df, "k", "ts", "30 minutes", "10 minutes", total=F.sum("v"))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_table(spark):
    assert got(found(spark.createDataFrame([*ROWS, (1, None, 5.0)], SCHEMA))) == brute(ROWS)
    assert got(found(spark.createDataFrame([], SCHEMA))) == []


def run(spark, tmp_path, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = S.write(found(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    return query, spark.read.parquet(str(tmp_path / "out"))


def test_stream_in_order_equals_the_table(spark, tmp_path):
    end = (9, T0 + dt.timedelta(days=30), 0.0)
    query, out = run(spark, tmp_path, ROWS[:90], ROWS[90:], [end])
    assert got(out.where("k < 9")) == brute(ROWS) and S.dropped(query) == 0


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    end = (9, T0 + dt.timedelta(days=30), 0.0)
    query, out = run(spark, tmp_path, ROWS, [end], [(7, T0, 1.0), (8, T0, 1.0), (7, T0 + dt.timedelta(days=31), 1.0)])
    assert S.dropped(query) == 2 and got(out.where("k < 7")) == brute(ROWS)
