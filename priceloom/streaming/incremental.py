"""Streaming fronts: queries as they arrive, and enrichment that resumes (OP-10, OP-39)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from priceloom.operators import compare, enrich, search

# Words that end a session; as queries they are passed over.
END_WORDS = ["salir", "exit", "quit"]


def answer_queries(asked: DataFrame, index: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, find: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Recommendations for a stream of queries (query_id, text, vec), appended to ``out`` once a micro-batch.

    ``find``: gives the candidates of a batch's queries, as ``clustered.top_candidates`` does; otherwise ``index`` is scanned.

    Each micro-batch writes a folder named by its number, so a batch that is repeated after a failure
    replaces its own output.
    """

    def each(batch: DataFrame, number: int) -> None:
        qs = search.queries(batch.where(~F.lower("text").isin(END_WORDS)))
        compare.compare(qs, index, candidates=find(qs) if find else None).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return asked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


class FirstRows(StatefulProcessor):
    """The first row of each key; later ones are passed over until ``again_after_s`` seconds have gone by (0: for good).

    The state store holds the time until which a key is done; a timer removes it then.
    """

    def __init__(self, again_after_s: float):
        self.again_after_ms = int(again_after_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs() if self.again_after_ms else 0
        if self.until.exists() and (not self.again_after_ms or now < self.until.get()[0]):
            return
        first = next(iter(rows), None)
        if first is not None:
            self.until.update((now + self.again_after_ms,))
            if self.again_after_ms:
                self.handle.registerTimer(now + self.again_after_ms)
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.until.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.until.get()[0]:
            self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, key: str = "sku", again_after_s: float = 0) -> DataFrame:
    """A stream's first row of each key, whatever micro-batches and restarts lie between; rows without a key are passed over."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = "ProcessingTime" if again_after_s else "None"
    return stream.where(F.col(key).isNotNull()).groupBy(key).transformWithState(FirstRows(again_after_s), stream.schema, "Append", timed)


def enrich_new(products: DataFrame, details: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, again_after_s: float = 0) -> StreamingQuery:
    """Enrich products whose sku was not enriched yet (or not for ``again_after_s`` seconds).

    Done skus are keyed state, so neither the output nor earlier batches are read again; the file sink's log and the
    checkpoint make a restart go on where it stopped.
    """
    spark, trigger = products.sparkSession, trigger or {"availableNow": True}
    new = enrich.enrich_a(first_rows(products, "sku", again_after_s), details)
    writer = new.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger)
    if "availableNow" not in trigger:
        return writer.start()
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")  # timers ask for one more batch after every batch, so the query would not end
    try:
        return writer.start()
    finally:
        spark.conf.set(NO_DATA, before)
