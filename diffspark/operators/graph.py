"""Graph statistics and traversal over ``edges(src, dst)``, both directions present."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted, kept


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))


#: Rows of a frontier, at most, that are sent to all tasks; a longer one is shuffled to the arcs.
SENT = 200_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` to be sent to all tasks if they are ``SENT`` at most, as they are if not. They are counted, so they should be kept."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def placed(arcs: DataFrame, on: list[str]) -> DataFrame:
    """The arcs dealt out by ``on`` once and kept, for the rounds of a traversal; to be unpersisted after."""
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arcs.repartition(n, *on).persist()


#: Arcs from which a traversal keeps them in files by buckets of their sources, about as many a bucket, and the rows of a frontier up to which it reads only the buckets that these are in.
STORED, A_BUCKET, PRUNED = 20_000_000, 100_000, 2_000


class Dealt:
    """Arcs for the rounds of a traversal: ``placed``, or beyond ``STORED`` arcs (counted) in files by buckets of ``src``, so that a round of a small frontier reads but a few of them."""

    def __init__(self, arcs: DataFrame, on: list[str]):
        n = arcs.count()
        self.buckets = min(1024, n // A_BUCKET + 1) if n > STORED else 0
        if self.buckets:
            tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            arcs = arcs.withColumn("_bucket", self._bucket("src"))
            self.arcs = kept(arcs.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", *on), "_bucket")
        else:
            self.arcs = placed(arcs, on)

    def _bucket(self, node: str) -> Column:
        return F.pmod(F.hash(node), F.lit(self.buckets))

    def around(self, front: DataFrame, size: int) -> DataFrame:
        """The arcs that ``size`` rows of ``front(src, ...)`` may meet."""
        if not self.buckets:
            return self.arcs
        if size > PRUNED:
            return self.arcs.drop("_bucket")
        own = [r[0] for r in front.select(self._bucket("src")).distinct().collect()]
        return self.arcs.where(F.col("_bucket").isin(own)).drop("_bucket")

    def unpersist(self) -> None:
        if not self.buckets:
            self.arcs.unpersist()


def explore(arcs: DataFrame, starts: DataFrame, *, keys: list[str] | None = None, coin: Column | None = None, mask: DataFrame | None = None, outside: DataFrame | None = None, max_depth: int | None = None, most: int | None = None, met: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """What ``starts(*keys, node)`` reach along ``arcs(*keys, src, dst)``, all keys at once: (keys, node, dist, parent), and with ``met`` the arcs that leave reached nodes (keys, src, dst).

    ``parent`` is the least node of the round before with an arc to the node, null for starts. ``coin``, over the keys, ``src``, ``dst``, other columns of the arcs and of ``starts``, says which arcs are live; it is asked only where a frontier meets an arc. ``mask(*some keys, node)`` restricts what may be reached, ``outside(*some keys, node)`` what may not; starts needn't be in the one or out of the other. A key that has reached ``most`` nodes goes no further.

    One round extends every key's frontier by a join, leaves out what was reached, and ends when no frontier is left: jobs grow with the depth, not with the number of keys. The arcs are dealt out once for all rounds. Each round is checkpointed.
    """
    keys = keys or []
    on, shared = [*keys, "node"], [k for k in keys if k in arcs.columns]
    carried = [c for c in starts.columns if c not in on]
    dealt = Dealt(arcs, [*shared, "src"])
    own = starts.select(*on, *carried).distinct()
    front, size = counted(own.select(*on, F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent"), *carried))
    done, total, parts, depth = front, size, [], 0
    while size and (max_depth is None or depth < max_depth):
        small = front.select(*keys, F.col("node").alias("src"), *carried)
        if most is not None:
            if not keys and total >= most:
                break
            if keys:
                small = small.join(done.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < most).select(*keys), keys, "left_semi")
        step = (F.broadcast(small) if size <= SENT else small).join(dealt.around(small, size), [*shared, "src"])
        if coin is not None:
            step = step.where(coin)
        step = step.select(*keys, "src", "dst", *carried)
        for nodes, how in ((mask, "left_semi"), (outside, "left_anti")):
            if nodes is not None:
                step = step.join(nodes.withColumnRenamed("node", "dst"), ["dst" if c == "node" else c for c in on if c in nodes.columns], how)
        if met:
            step = checkpoint(step)
            parts.append(step.select(*keys, "src", "dst"))
        depth += 1
        new = step.groupBy(*keys, F.col("dst").alias("node"), *carried).agg(F.min("src").alias("parent"))
        before = done.select(*on)
        front, size = counted(new.join(F.broadcast(before) if total <= SENT else before, on, "left_anti").select(*on, F.lit(depth).alias("dist"), "parent", *carried))
        done, total = done.unionByName(front), total + size
        if depth % 8 == 0:
            done = checkpoint(done)
    dealt.unpersist()
    found = reduce(DataFrame.unionByName, parts) if parts else own.limit(0).select(*keys, F.col("node").alias("src"), F.col("node").alias("dst")) if met else None
    return done.select(*on, "dist", "parent"), found


def ball(edges: DataFrame, starts: DataFrame, size: int, *, keys: list[str] | None = None) -> DataFrame:
    """The ``size`` nodes nearest to the starts of each key, of the last level those of lowest id: keys, node, dist. A key's search ends with the level that fills its ball."""
    keys = keys or []
    found = explore(edges, starts.select(*keys, "node"), keys=keys, most=size)[0].drop("parent")
    if not keys:
        return top(found, size, F.col("dist"), F.col("node"))
    order = W.partitionBy(*keys).orderBy("dist", "node")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).drop("_place")


def reach(arcs: DataFrame, starts: DataFrame, *, keys: list[str] | None = None, max_depth: int | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Hop distances from ``starts(*keys, node)`` along ``arcs(*keys, src, dst)``, all keys at once: keys, node, dist (see ``explore``)."""
    keys = keys or []
    return explore(arcs, starts.select(*keys, "node"), keys=keys, max_depth=max_depth, mask=mask)[0].drop("parent")


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component: node, component. Labels are lowered by joins over edges and halved by pointer jumps, so rounds grow as the logarithm of the diameter."""
    labels = checkpoint(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jumped"))
        new = checkpoint(low.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jumped", "next")).alias("next"), F.col("component").alias("before")))
        labels = new.select("node", F.col("next").alias("component"))
        if new.where("next <> before").isEmpty():
            return labels


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: n, m, avg_degree, n_components, lcc."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    whole = degrees(edges).agg(F.count("*").alias("n"), (F.sum("deg") / 2).cast("long").alias("m"), F.avg("deg").alias("avg_degree"))
    return whole.crossJoin(sizes.agg(F.count("*").alias("n_components"), F.max("size").alias("lcc")))


def pagerank(edges: DataFrame, *, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """node, rank after a fixed number of power iterations; every node has an arc, so no rank dangles."""
    deg = checkpoint(degrees(edges))
    n = deg.count()
    edges = placed(edges, ["src"])
    rank = deg.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(iterations):
        flow = edges.join(rank.join(deg, "node").select(F.col("node").alias("src"), (F.col("rank") / F.col("deg")).alias("share")), "src")
        rank = flow.groupBy(F.col("dst").alias("node")).agg((F.lit((1 - damping) / max(n, 1)) + damping * F.sum("share")).alias("rank"))
        if i % 5 == 4:
            rank = checkpoint(rank)
    rank = checkpoint(rank)
    edges.unpersist()
    return rank


def induced(edges: DataFrame, members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Arcs between members(*keys, node), for each key: keys, src, dst."""
    keys = keys or []
    near = members.select(*keys, F.col("node").alias("src")).join(edges, "src")
    return near.join(members.select(*keys, F.col("node").alias("dst")), [*keys, "dst"], "left_semi").select(*keys, "src", "dst")


def pairwise_hops(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Distances between members of a key within the graph that they induce: keys, root, node, dist."""
    arcs = checkpoint(induced(edges, members, keys))
    starts = members.select(*keys, F.col("node").alias("root"), "node")
    return reach(arcs, starts, keys=[*keys, "root"])


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)
