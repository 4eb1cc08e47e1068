"""Connected components of an edge table: least labels with pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (columns a, b); label: the least node of its component.

    Each round takes the least label among the neighbours and then follows it once (pointer
    jumping).  Labels and edges are read from written tables, so both sides of each join are plain
    exchanges that adaptive execution may split when a hub node holds many rows; the least label
    is aggregated before it is shuffled.  Nothing is collected but a yes or no.
    """
    both = C.materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = C.materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        old = labels.select("node", "label")
        near = both.join(old, both.b == old.node).groupBy(both.a.alias("node")).agg(F.min("label").alias("near"))
        step = old.withColumnRenamed("label", "was").join(near, "node").select("node", "was", F.least("was", "near").alias("via"))
        jump = old.select(F.col("node").alias("via"), "label")
        labels = C.materialize(step.join(jump, "via").select("node", F.least("via", "label").alias("label"), (F.least("via", "label") != F.col("was")).alias("moved")), "labels")
    return labels.select("node", "label")
