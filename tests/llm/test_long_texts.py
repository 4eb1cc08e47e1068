"""One text of some megabytes beside a short and a null one: read whole, to its last line."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from priceloom.llm import context_tree, decontaminate, language_id, license_scan, line_dedup, quality_rules, simhash, warc
from tests.llm import test_simhash
from tests.llm.docs import PROSE, frame

RND = random.Random(2)
WORDS = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randrange(2, 10))) for _ in range(5000)]
LINES = 40_000
LONG = "\n".join(" ".join(RND.choice(WORDS) for _ in range(12)) + f" {i}" for i in range(LINES)) + "\nthe very last line of all, under the mit license"
ITEM = LONG[-100:].replace("\n", " ")
SHARED = LONG.rsplit("\n", 1)[1]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [LONG, PROSE, None, SHARED, PROSE + "\n" + SHARED], extra=False).cache()


def first(df):
    return df.where("row.doc_id = 0").first()


def test_operators_read_it_whole(spark, docs):
    assert len(LONG) > 2_500_000
    n = 13 * LINES + 10
    q = first(quality_rules.quality_rules(docs, keep=["doc_id"]))
    assert (q.n_words, q.n_dup_lines, q.n_repeat_words, q.kept) == (n, 0, 0, True)
    d = first(line_dedup.line_dedup(docs, keep=["doc_id"]))
    assert (d.n_lines, d.n_dropped, d.kept_text) == (LINES + 1, 1, LONG.rsplit("\n", 1)[0])
    s = first(license_scan.scan(docs, keep=["doc_id"]))
    assert (s.n_words, s.base_labels, s.last_word) == (n, "mit", n - 2)
    t = first(context_tree.score(docs, F.lit(True), keep=["doc_id"]))
    assert (t.n_tokens, t.n_known) == (n + 1, n + 1) and t.bits_per_byte < 5
    assert first(language_id.identify(docs, F.lit(True), keep=["doc_id"])).lang_pred == "en"
    bench = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    leak = first(decontaminate.leaks(docs, bench, keep=["doc_id"])).leaks[0]
    assert (leak.item_id, leak.edits, leak.start, leak.end) == (7, 0, len(LONG) - 100, len(LONG))
    got = {r.id: r.fp % 2**64 for r in simhash.near_dedup(docs).collect()}
    assert got[0] == test_simhash.brute_fp(LONG)


def test_archive_keeps_it_whole(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    back = {r.record_id: r.payload_bytes for r in warc.round_trip(pages).collect()}
    assert back[f"{warc.URN}0"] == len(LONG) and len(back) == 5


def test_pipeline_stages_read_it_whole(spark, docs, tmp_path):
    spark.createDataFrame([(7, "an item that no document holds, of some length")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        row = stage(spark, docs, str(tmp_path)).where("doc_id = 0").first()
        assert row.text == (LONG.rsplit("\n", 1)[0] if name == "line_dedup" else LONG), name
    assert row.round_trip and row.n_tokens > 13 * LINES
