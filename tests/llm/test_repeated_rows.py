"""Every operator over a table whose rows are there twice, with columns of the operators' own names: both rows come out alike."""

import pytest
from pyspark.sql import functions as F

from priceloom.llm import bpe, context_tree, decontaminate, language_id, license_scan, line_dedup, quality_classifier, quality_rules, simhash, token_alignment
from tests.llm.docs import TEXTS, frame

NAMES = ["text_", "row_", "id", "key", "keys", "number", "line", "drop", "words", "numbers", "gaps", "folded", "ids", "fp", "component", "leaks", "labels", "score", "lang_pred", "own", "g0", "n", "x", "host", "path", "vote", "logs", "rest", "grams", "more_best", "pair", "n_a", "groups"]
P = pytest.importorskip("public_tokenizers")


def benchmark(spark):
    return spark.createDataFrame([(1, TEXTS[6][:120])], "item_id bigint, text string")


OPERATORS = {
    "quality_classifier": lambda df: quality_classifier.classify(df, df.sparkSession.createDataFrame([(6, 1), (10, 0)], "doc_id bigint, quality int"), F.col("source"), F.col("lang")),
    "decontaminate": lambda df: decontaminate.leaks(df, benchmark(df.sparkSession)),
    "context_tree": lambda df: context_tree.score(df, F.lit(True), hot=50).withColumns({c: F.round(c, 6) for c in ("score", "base_score", "bits_per_byte")}),
    "line_dedup": line_dedup.line_dedup,
    "license_scan": license_scan.scan,
    "quality_rules": quality_rules.quality_rules,
    "bpe": lambda df: bpe.encode(df, bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, hot=20),
    "token_alignment": lambda df: token_alignment.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), hot=30),
    "language_id": lambda df: language_id.identify(df, F.lit(True)).drop("rejected").withColumns({c: F.round(c, 6) for c in ("score", "cross_entropy")}),
    "simhash": lambda df: simhash.near_dedup(df).select(F.struct(F.col("id").alias("doc_id")).alias("row"), "fp", "component"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_both_rows_come_out_alike(spark, name):
    df = frame(spark).select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    got = OPERATORS[name](df.union(df)).collect()
    assert len(got) == 2 * len(TEXTS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.row.doc_id, []).append(r)
        assert name == "simhash" or all(r.row[c] == f"own {c}" for c in NAMES)
    assert all(len(pair) == 2 and repr(pair[0]) == repr(pair[1]) for pair in by_id.values())
