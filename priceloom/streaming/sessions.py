"""Sessions of a stream of queries by event time (OP-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(asked: DataFrame, by: str, time: str, gap: str, late: str, **more: Column) -> DataFrame:
    """(by, begun, ended, n, and the aggregates ``more``) of runs of rows no further apart than ``gap``.

    Rows later than ``late`` behind the newest are left out (``dropped`` counts them); a session comes out once
    that line has passed its end.  Of a batch table the same, with nothing late.
    """
    timed = asked.withWatermark(time, late) if asked.isStreaming else asked
    found = timed.where(F.col(time).isNotNull()).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items()))
    return found.select(by, F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n", *more)


def write(found: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def dropped(query: StreamingQuery) -> int:
    """How many rows came too late, in the batches that the query remembers (see spark.sql.streaming.numRecentProgressUpdates).

    Rows of one batch, key and session that are late together count as one.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
