"""Mergeable sketches of runs: distinct keys and quantiles of prices (OP-37, OP-42).

A run's rows are sketched once, by group, into a table of a few kilobytes a group; later questions merge the sketches of any runs
and never read the rows again.  Errors: about 1.04 / sqrt(2 ** ``LOG2_BUCKETS``) of a distinct count, about 2 / ``RANKS`` of a quantile's rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG2_BUCKETS, RANKS = 14, 400
TABLE = "run string, n bigint, keys binary, prices binary"


def sketch(rows: DataFrame, run: str, key: str, price: str) -> DataFrame:
    """(run, n, keys, prices) for each value of the column ``run``; null keys and prices are not counted."""
    return rows.groupBy(F.col(run).cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(key), LOG2_BUCKETS).alias("keys"), F.kll_sketch_agg_double(F.col(price).cast("double"), RANKS).alias("prices"))


def append(sketches: DataFrame, path: str) -> None:
    """Add a run's sketches to the stored ones."""
    sketches.write.mode("append").parquet(path)


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of all runs together, or by columns of the table."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("prices").alias("prices"))


def read(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """The estimates: ``distinct`` and ``quantiles``, in place of the sketches."""
    told = F.when(F.kll_sketch_get_n_double("prices") > 0, F.array(*(F.kll_sketch_get_quantile_double("prices", F.lit(float(q))) for q in quantiles)))
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("keys"), "quantiles": told}).drop("keys", "prices")
