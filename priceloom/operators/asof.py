"""As-of and interval joins over price histories (OP-41's runs).

As-of: every left row gets the last right row of its key at or before its time.  Both sides are put together and each key's
rows are walked in order of time by a window, so no pair of rows is ever formed.  A key with more than ``MOST`` rows is cut in time, at
its own quantiles: each piece is walked by itself, and what a piece begins with is carried over from the pieces before, of
which there is one row each.  Where no key is that large, one exchange does it all.

Interval: points and the half-open intervals [start, stop) of their key that hold them.  Intervals are dealt to bins of time, as
many as they cover, and points to their one bin, so the join is on equal (key, bin); ``width`` should be near the usual
length of an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 1 << 20
PIECES = 64  # that such a key is cut into
SPREAD = 1024  # for rows without a key or time
ACCURACY = 10_000  # of the quantiles that keys are cut at


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str | None = None, most: int = MOST, strict: bool = False) -> DataFrame:
    """``left`` with the columns of the last ``right`` row of its key at or before (``strict``: before) its time; nulls where there is none.

    The right time comes as ``<time>_right``.  Right rows with a null key or time match nothing, and left rows with one get
    nulls.  Of right rows of the same time the greatest by their columns, in order, counts.  A column that both sides have, but for the
    key and the time, is an error.
    """
    right_time = right_time or time
    values = [c for c in right.columns if c not in (key, right_time)]
    if clash := [c for c in [*values, f"{time}_right"] if c in left.columns]:
        raise ValueError(f"both sides have the columns {clash}")
    kind = left.schema[time].dataType
    lefts = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(not strict).cast("int").alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(right_time, *values).alias("r")).schema["r"].dataType).alias("r"))
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    rights = rights.select(F.col(key).cast(left.schema[key].dataType).alias("k"), F.col(right_time).cast(kind).alias("t"), F.lit(int(strict)).alias("side"), F.lit(None).cast(lefts.schema["l"].dataType).alias("l"), F.struct(right_time, *values).alias("r"))
    rows = lefts.union(rights)

    large = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("k").alias("hk"))
    cut = not large.isEmpty()
    if cut:
        at = _number(F.col("t"), kind)
        cuts = rows.join(large, F.col("k") == F.col("hk")).groupBy("hk").agg(F.array_distinct(F.percentile_approx(at, [i / PIECES for i in range(1, PIECES)], ACCURACY)).alias("cuts"))
        rows = rows.join(cuts, F.col("k") == F.col("hk"), "left").withColumn("piece", F.coalesce(F.size(F.filter("cuts", lambda c: c < at)), F.lit(0))).drop("hk", "cuts")
    else:
        rows = rows.withColumn("piece", F.lit(0))
    # rows that match nothing are dealt anywhere, as they may be many
    anywhere = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    rows = rows.withColumn("piece", F.when(F.col("k").isNull() | F.col("t").isNull(), anywhere).otherwise(F.col("piece")))

    found = _last(F.col("r"), Window.partitionBy("k", "piece").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = rows.withColumn("found", found).where(F.col("l").isNotNull())
    if cut:
        ends = rows.where(F.col("r").isNotNull()).groupBy("k", "piece").agg(F.max(F.struct("t", "r")).alias("end"))  # a row for each piece
        pieces = rows.select("k", "piece").distinct().join(ends, ["k", "piece"], "left")
        before = _last(F.col("end.r"), Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
        carried = pieces.select(F.col("k").alias("ck"), F.col("piece").alias("cp"), before.alias("carried"))
        walked = walked.join(carried, (F.col("k") == F.col("ck")) & (F.col("piece") == F.col("cp")), "left").withColumn("found", F.coalesce("found", "carried"))
    good = F.col("k").isNotNull() & F.col("t").isNotNull()
    got = lambda c: F.when(good, F.col("found")[c])
    return walked.select("l.*", got(right_time).alias(f"{time}_right"), *(got(c).alias(c) for c in values))


def _number(c: Column, kind: T.DataType) -> Column:
    """A time or number as a number in the same order; microseconds of times."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):  # of the wall clock, whatever the session's zone does
        day = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
        return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return c.cast("double")


def _last(c: Column, over) -> Column:
    return F.last(c, ignorenulls=True).over(over)


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, stop: str, width_s: float) -> DataFrame:
    """Each point with each interval of its key that holds its time (start <= time < stop), as an inner join.

    Rows with a null key or time, and intervals without extent, match nothing.
    """
    if clash := [c for c in intervals.columns if c in points.columns and c != key]:
        raise ValueError(f"both sides have the columns {clash}")
    width = int(width_s * 1_000_000)
    bin_of = lambda c: F.floor(_number(c, points.schema[time].dataType) / F.lit(width))
    dealt = intervals.where(F.col(stop) > F.col(start)).withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(stop) - F.expr("INTERVAL 1 MICROSECOND")))))
    met = points.withColumn("__bin", bin_of(F.col(time))).join(dealt, [key, "__bin"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))).drop("__bin")
