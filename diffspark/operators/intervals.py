"""How many intervals are open at a time, without a single task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint


def open_counts(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The number of ``intervals`` (both ends included) that are open from each time on at which it changes or an interval begins or has ended: at, open.

    A sweep over the events: one more at each start, one less behind each end. Events are summed by time, dealt out by ranges of time, and each range's running sums begin at the total of the ranges before, one number each. Intervals with a null end, or that end before they start, are left out. ``at`` is a pair (time, after): after is true for what holds right behind that time.
    """
    rows = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    events = rows.select(F.col(start).alias("time"), F.lit(False).alias("after"), F.lit(1).alias("d")).unionByName(rows.select(F.col(end).alias("time"), F.lit(True).alias("after"), F.lit(-1).alias("d")))
    sums = events.groupBy("time", "after").agg(F.sum("d").alias("d"))
    n = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpoint(sums.repartitionByRange(n, "time", "after").withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(F.sum("d").alias("_total"))  # a row for each range
    before = totals.select("_range", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("d").over(W.partitionBy("_range").orderBy("time", "after"))
    return ranges.withColumn("_inside", inside).join(F.broadcast(before), "_range").select("time", "after", (F.col("_inside") + F.col("_before")).alias("open"))


def most_open(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """One row: open, the greatest number of intervals open at a time (0 without any)."""
    return open_counts(intervals, start, end).agg(F.coalesce(F.max("open"), F.lit(0)).alias("open"))
