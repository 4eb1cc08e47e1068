from collections import Counter

import pytest
from pyspark.sql import functions as F

from priceloom.operators import index as I
from priceloom.operators import compare as P
from priceloom.operators import search as S
from priceloom.streaming import incremental as T


def test_queries_as_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i, str(i), f"tornillo {i} caja 10 un", 100.0 + i, "u", "", [1.0, i / 10]) for i in range(6)]
    df = spark.createDataFrame(rows, "idx int, sku string, titulo string, precio_clp double, url string, medida_extraida string, v array<float>")
    ix = I.build(df, "a", F.col("v"), F.col("idx")).union(I.build(df, "b", F.col("v"), F.col("idx")))
    asked = spark.createDataFrame([(1, "tornillo 3", [1.0, 0.3]), (2, "SALIR", [1.0, 0.0])], "query_id long, text string, vec array<double>")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    T.answer_queries(stream, ix, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "winner", "saving").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in P.compare(S.queries(asked.where("query_id = 1")), ix).collect()] == [(1, "tie", 0.0)]


def test_enrichment_resumes(spark, tmp_path):
    pages = spark.createDataFrame([("u", "<p>")], "url string, html string")
    schema = "sku string, url string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for skus in (["1", "2", "2"], ["2", "3"]):
        spark.createDataFrame([(s, "u") for s in skus], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        T.enrich_new(stream, pages, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.sku for r in rows) == ["1", "2", "3"] and rows[0].descripcion == "Sin descripción"


def run(spark, tmp_path, skus, **options):
    schema, src = "sku string, url string", str(tmp_path / "in")
    spark.createDataFrame([(s, "u") for s in skus], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = T.enrich_new(stream, spark.createDataFrame([("u", "<p>")], "url string, html string"), str(tmp_path / "out"), str(tmp_path / "cp"), **options)
    q.awaitTermination()
    return q, Counter(r.sku for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_done_keys_are_state(spark, tmp_path):
    """Repeats are skipped after a restart, though the output has gone meanwhile; rows without a key are passed over."""
    _, first = run(spark, tmp_path, ["1", "2", "2", None])
    assert first == {"1": 1, "2": 1}
    for f in (tmp_path / "out").glob("part-*"):
        f.write_bytes(b"not read again")
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "out")).collect()
    spark.createDataFrame([("2", "u"), ("3", "u"), ("1", "u")], "sku string, url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sku string, url string").parquet(str(tmp_path / "in"))
    q = T.enrich_new(stream, spark.createDataFrame([("u", "<p>")], "url string, html string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"]) >= 3
    good = [f for f in (tmp_path / "out").glob("part-*") if f.read_bytes()[:4] == b"PAR1"]
    assert [r.sku for r in spark.read.parquet(*map(str, good)).collect()] == ["3"]


def test_keys_come_again_after_a_while(spark, tmp_path):
    _, first = run(spark, tmp_path, ["1", "2"], again_after_s=0.001)
    _, again = run(spark, tmp_path, ["1", "1", "3"], again_after_s=0.001)
    assert first == {"1": 1, "2": 1} and again == {"1": 2, "2": 1, "3": 1}
    _, third = run(spark, tmp_path, ["3", "4"], again_after_s=3600)
    assert third["4"] == 1 and third["1"] == 2
