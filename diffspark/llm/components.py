"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.llm._common import gathered

#: Edges, at most, of a graph whose least neighbours are sent to all tasks.
SENT = 100_000


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges(a, b)`` can reach: node, component.

    Alternating large-star and small-star rewriting: every round each node links its larger neighbours, then its smaller ones and itself, to the least node around it, until every edge is a node and its component's least. Rounds grow as the logarithm of the longest path. Each is two grouped minima and joins over edges, and is checkpointed; what is left of it is read in as few partitions as its edges need. No component is gathered anywhere, and a node of many neighbours is one key of a join that Spark can split.
    """
    now = gathered(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    few = now.count() <= SENT  # edges never become more
    parts = max(1, now.rdd.getNumPartitions())  # an empty table may have none

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        """pairs(u, v), u > v. small: over each u's smaller neighbours; else over every node's neighbours, moving the larger ones."""
        around = pairs if small else pairs.union(pairs.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = around.join(F.broadcast(least) if few else least, "u")
        if small:
            moved = joined.select(F.col("v").alias("x"), "m").union(least.select("u", "m"))
        else:
            moved = joined.where("v > u").select(F.col("v").alias("x"), "m")
        out = moved.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        return out.coalesce(parts) if few else out

    while True:
        now = gathered(star(star(now, False), True))
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        # Done if every node has one edge upwards at most, and none that leads to it then.
        open_ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if open_ends.isEmpty():
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
