"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame with the columns of ``documents``; the last one adds the token ids.

Stages work on rows, not on ids: null and repeated ids, repeated rows, null and empty texts and columns of any name
come through (``bpe`` replaces columns of the names that it adds).  An empty table gives an empty table; very
long texts are read whole.  The quality rules reject null, empty and short texts.  Of equal ids in a group of
copies one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejected documents go."""
    from priceloom.llm.quality_rules import quality_rules

    return quality_rules(docs).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated lines go; text and n_chars are those of the lines that stay."""
    from priceloom.llm.line_dedup import line_dedup

    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return line_dedup(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 over rows: the row with the least id of each group stays (null ids last), one row whatever the ids are."""
    from priceloom.llm.common import materialize
    from priceloom.llm.simhash import near_dedup

    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed-rows")
    rank = F.struct(F.col("row.doc_id").isNull().alias("missing"), F.col("row.doc_id").alias("doc_id"), F.col("key").alias("key"))
    gone = near_dedup(rows.select(rank.alias("rank"), F.col("row.text").alias("text")), "rank").where("id.key <> component.key").select("id.key")
    return rows.join(gone, "key", "left_anti").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    from priceloom.llm.decontaminate import leaks

    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids, and whether decoding them gives the text again; columns of these names are replaced."""
    import public_tokenizers

    from priceloom.llm.bpe import read_ranks, round_trip

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = round_trip(docs, ranks, public_tokenizers.PATTERN)
    text = F.coalesce("row.text", F.lit("")).cast("binary")
    new = {"n_tokens": F.size("ids").cast("bigint"), "ids": F.col("ids"), "round_trip": F.col("decoded") == text}
    return coded.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", benchmark), ("bpe", tokens)]

#: SimHash and byte-pair merges cannot be written in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet and reread as the next one's input, and then
    what the stages before have written is deleted."""
    from priceloom.llm.common import materialize, release, written

    since = written()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            release(spark, since, keep=1)
    return docs
