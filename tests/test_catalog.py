"""The SQL functions give what the expressions give, and are planned alike."""

from pyspark.sql import functions as F

from priceloom.functions import catalog
from priceloom.operators import envelope as E
from tests.test_functions import NORMAL, QUANTITIES, SIZES


def test_functions(spark):
    names = catalog.register(spark)
    assert names == [*catalog.TEXT, "specification_rows"]
    texts = [*SIZES, *QUANTITIES, *NORMAL, None, "it's 2'' x \\ tab\t<b>&quot;</b>", '<script id="__NEXT_DATA__" type="application/json">{}</script>']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = df.select("i", *(body(F.col("t")).alias(name) for name, (_, body) in catalog.TEXT.items())).orderBy("i").collect()
    got = spark.sql("SELECT i, " + ", ".join(f"{name}(t) AS {name}" for name in catalog.TEXT) + " FROM {df} ORDER BY i", df=df).collect()
    assert got == want


def test_table_function(spark):
    catalog.register(spark)
    kind = "i int, entries array<struct<name: string, values: array<string>>>"
    lists = [[("a", ["1"]), ("b", []), ("a", ["2", "3"]), ("", ["x"]), (None, ["y"]), ("c", [None])], [], None, [("a", ["1"]), ("a", None)]]
    df = spark.createDataFrame(list(enumerate(lists)), kind)
    want = {r.i: r.m for r in df.where("entries IS NOT NULL").select("i", E.specifications(F.col("entries")).alias("m")).collect()}
    got = {i: {} for i in want}
    for r in spark.sql("SELECT i, s.key, s.value FROM {df}, LATERAL specification_rows(entries) s", df=df).collect():
        got[r.i][r.key] = r.value
    assert got == want
    plan = spark.sql("SELECT i, s.key FROM {df}, LATERAL specification_rows(entries) s", df=df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
