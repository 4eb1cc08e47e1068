import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from priceloom.llm import line_dedup as L
from tests.llm.docs import TEXTS, frame

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[line.strip(SPACE).translate(LOWER)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(SPACE).translate(LOWER)) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def check(spark, texts, **options):
    got = L.line_dedup(frame(spark, texts), keep=["doc_id"], **options).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(list(enumerate(texts))) and len(got) == len(texts)


def test_equals_brute_force(spark):
    check(spark, TEXTS)
    shared = ["a line that is in every document of this set", "Another Line which is found in many of them\t", "x" * 300]
    check(spark, [f"own {i}\n" + "\n".join(shared[: i % 4]) + "\n" + shared[0].upper() for i in range(40)])


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "FLUSH", 5)
    check(spark, TEXTS + [f"line number {i % 9} of a long shared set" for i in range(60)], bits=L.SEGMENT_BITS * 2)


def test_empty_table_repeats_and_null_ids(spark):
    assert L.line_dedup(frame(spark).limit(0)).count() == 0
    df = frame(spark, ["This is a line that many documents share"] * 4)
    twice = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = [(r.doc_id, r.n_dropped) for r in L.line_dedup(twice).select("row.doc_id", "n_dropped").collect()]
    assert sorted(got, key=str) == sorted([(None, 1)] * 2 + [(1, 1)] * 2 + [(2, 1)] * 2 + [(3, 0)] * 2, key=str)
    assert L.line_dedup(df).select("row.*").columns == df.columns


def test_columns_of_internal_names_survive(spark):
    df = frame(spark, ["This is a line that many documents share\nown"] * 4)
    odd = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["__drop", "drop", "keys", "number", "id", "line", "keeper", "n_lines"])])
    got = L.line_dedup(odd).collect()
    assert sorted(r.n_dropped for r in got) == [0, 1, 1, 1] and all(r.row.number == 3 and r.row["__drop"] == 0 for r in got)


def test_twins_are_two_lines(spark):
    """Lines of one polynomial hash are different keys."""
    from tests.llm.docs import TWINS

    check(spark, ["\n".join(TWINS)] * 4 + [TWINS[0]])
