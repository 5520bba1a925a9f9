"""Greedy planners that look at few candidates, or at few worlds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.operators.diffusion import worlds_from
from diffspark.operators.dominators import ancestors, dominators, roots_of, undominated, without_nodes
from diffspark.operators.graph import explore, top

KEYS = ["sample"]


def subtree_bounds(tree: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Upper bounds of what blocking a node saves over all worlds: node, bound. What it dominates lies below it in any spanning tree, so the nodes below it in one, itself included, are as many at least."""
    own = tree.where("parent is not null").select("node", F.lit(1).alias("n"))
    return own.unionByName(pairs.select(F.col("cut").alias("node"), F.lit(1).alias("n"))).groupBy("node").agg(F.sum("n").alias("bound"))


def _repaired(tree: DataFrame, live: DataFrame, lost: DataFrame, gone: DataFrame) -> DataFrame:
    """A spanning tree without ``gone(sample, node)``: nodes of ``lost``, which hung below a pick and are still reached, are entered from outside again. Only they are walked."""
    kept = tree.join(gone.unionByName(lost), [*KEYS, "node"], "left_anti").select(*KEYS, "node", "parent")
    into = live.join(lost.withColumnRenamed("node", "dst"), [*KEYS, "dst"], "left_semi").join(kept.select(*KEYS, F.col("node").alias("src")), [*KEYS, "src"], "left_semi")
    entry = checkpoint(into.groupBy(*KEYS, F.col("dst").alias("node")).agg(F.min("src").alias("parent")))
    inner = explore(live, entry.select(*KEYS, "node"), keys=KEYS, mask=lost)[0].where("dist > 0").select(*KEYS, "node", "parent")
    return checkpoint(kept.unionByName(entry.select(*KEYS, "node", "parent")).unionByName(inner))


def celf_greedy(live: DataFrame, seeds: DataFrame, k: int, *, batch: int = 32) -> DataFrame:
    """The picks of ``advanced_greedy``, with few candidates evaluated: rank, node, gain, evaluated (candidates whose gain was worked out for this pick), candidates (all that there were).

    A table of upper bounds by candidate, from a spanning tree of what is reached in each world, is worked down from the top: ``batch`` candidates of largest bound have their gains worked out, all worlds and candidates at once and only below them in the tree (``undominated``), until the best gain is no less than any bound that is left. Since savings aren't submodular here, gains of earlier picks would be no bounds; those of the tree of what is left are. After a pick only the nodes that hung below it are walked again.
    """
    seeds = checkpoint(roots_of(live, seeds, KEYS))
    live = checkpoint(live.select(*KEYS, "src", "dst"))
    tree = checkpoint(explore(live, seeds, keys=KEYS)[0].select(*KEYS, "node", "parent"))
    live = checkpoint(live.join(tree.select(*KEYS, F.col("node").alias("src")), [*KEYS, "src"], "left_semi"))
    plan = []
    for rank in range(1, k + 1):
        hung = tree.where("parent is not null").select(*KEYS, F.col("node").alias("cut"))  # no seeds
        pairs = checkpoint(ancestors(tree, KEYS).join(hung, [*KEYS, "cut"], "left_semi"))
        bounds, candidates = counted(subtree_bounds(tree, pairs, KEYS))
        if not candidates:
            break
        best, evaluated, left = None, 0, bounds
        while True:
            part = checkpoint(top(left, batch, F.col("bound").desc(), F.col("node")))
            saved = part.join(undominated(pairs.join(part.select(F.col("node").alias("cut")), "cut", "left_semi"), live, KEYS).groupBy(F.col("cut").alias("node")).agg(F.count("*").alias("free")), "node", "left")
            saved = saved.select("node", (F.col("bound") - F.coalesce("free", F.lit(0))).alias("gain"))
            row = saved.orderBy(F.col("gain").desc(), "node").first()
            evaluated += part.count()
            best = row if best is None or (row["gain"], -row["node"]) > (best["gain"], -best["node"]) else best
            left = left.join(part.select("node"), "node", "left_anti")
            rest = left.where((F.col("bound") > best["gain"]) | ((F.col("bound") == best["gain"]) & (F.col("node") < best["node"])))
            if rest.isEmpty():
                break
            left = checkpoint(left)
        if best["gain"] <= 0:
            break
        plan.append((rank, best["node"], best["gain"], evaluated, candidates))
        if rank < k:
            below = checkpoint(pairs.where(F.col("cut") == best["node"]))
            lost = checkpoint(undominated(below, live, KEYS).select(*KEYS, "node"))
            gone = below.select(*KEYS, "node").join(lost, [*KEYS, "node"], "left_anti").unionByName(tree.where(F.col("node") == best["node"]).select(*KEYS, "node"))
            gone = checkpoint(gone)
            live = checkpoint(without_nodes(live, gone))
            tree = _repaired(tree, live, lost, gone)
    return live.sparkSession.createDataFrame(plan, "rank int, node long, gain long, evaluated long, candidates long")


def separation(gains: DataFrame, worlds: int, leader: int, *, z: float | None = 2.5, delta: float = 0.1) -> DataFrame:
    """Whether each candidate's mean gain over ``worlds`` lies below that of the ``leader`` beyond chance: node, apart.

    ``gains(sample, node, gain)``; worlds in which a node has no row count as 0. Paired: all see the same worlds, so the mean of the differences is compared with ``z`` of its standard errors. ``z`` None: empirical Bernstein bounds of each mean, with an error of ``delta`` over all candidates, whatever the gains' distribution.
    """
    lead = gains.where(F.col("node") == leader).select("sample", F.col("gain").alias("_lead"))
    rows = gains.join(F.broadcast(lead), "sample", "left").na.fill(0, ["_lead"])
    sums = rows.groupBy("node").agg(F.sum("gain").alias("s"), F.sum(F.col("gain") * F.col("gain")).alias("q"), F.sum(F.col("gain") * F.col("_lead")).alias("c"), F.max("gain").alias("m"))
    whole = sums.where(F.col("node") == leader).select(F.col("s").alias("_s"), F.col("q").alias("_q"), F.col("m").alias("_m"))
    rows = sums.where(F.col("node") != leader).crossJoin(F.broadcast(whole))  # one row
    n = float(worlds)
    if z is not None:
        d, square = F.col("_s") - F.col("s"), F.col("_q") - 2 * F.col("c") + F.col("q")
        error = F.sqrt(F.greatest(F.lit(0.0), square - d * d / n) / max(n - 1, 1) / n)
        return rows.select("node", (d / n > z * error).alias("apart"))
    log = math.log(3 / delta)

    def radius(s: str, q: str):
        return F.sqrt(2 * F.greatest(F.lit(0.0), F.col(q) / n - F.col(s) * F.col(s) / n / n) * log / n) + 3 * F.greatest("m", "_m") * log / n

    return rows.select("node", ((F.col("_s") - F.col("s")) / n > radius("s", "q") + radius("_s", "_q")).alias("apart"))


def racing_greedy(arcs: DataFrame, seeds: DataFrame, k: int, *, first: int = 50, batch: int = 50, most: int = 2000, z: float | None = 2.5, delta: float = 0.1, seed: int = 7) -> DataFrame:
    """Greedy picks by as many worlds as each needs: rank, node, gain (sum over the worlds), worlds, left (candidates not set apart at the end, the pick not counted).

    Each pick is a race of all candidates on the same worlds. ``batch`` worlds at a time are added to the ``first`` ones, up to ``most``; after each, the candidates that lie below the leader beyond chance (``separation``) drop out of the race, until the leader is alone. Only new worlds are drawn and only worlds that reach a pick are worked on again.
    """
    spark = arcs.sparkSession
    seeds = checkpoint(seeds.select("node"))
    arcs = checkpoint(arcs.select("src", "dst", "p"))
    live = tree = None
    worlds, plan, picks = 0, [], []

    def more(to: int):
        nonlocal live, tree, worlds
        new = checkpoint(worlds_from(arcs, seeds, to, first=worlds, seed=seed)[1])
        if picks:
            new = checkpoint(without_nodes(new, spark.createDataFrame([(p,) for p in picks], "node long")))
        own = dominators(new, seeds, keys=KEYS)
        live = new if live is None else live.unionByName(new)
        tree = checkpoint(own if tree is None else tree.unionByName(own))
        worlds = to

    more(min(first, most))
    for rank in range(1, k + 1):
        race = None
        while True:
            gains = tree.where("not seed").select("sample", "node", F.col("size").alias("gain"))
            if race is not None:
                gains = gains.join(race, "node", "left_semi")
            totals = gains.groupBy("node").agg(F.sum("gain").alias("gain"))
            best = totals.orderBy(F.col("gain").desc(), "node").first()
            if best is None:
                break
            near, n = counted(separation(gains, worlds, best["node"], z=z, delta=delta).where("not apart").select("node"))
            if not n or worlds >= most:
                break
            race = checkpoint(near.unionByName(spark.createDataFrame([(best["node"],)], "node long")))
            more(min(worlds + batch, most))
        if best is None:
            break
        plan.append((rank, best["node"], best["gain"], worlds, n))
        picks.append(best["node"])
        if rank < k:
            hit = spark.createDataFrame([(best["node"],)], "node long")
            dirty = checkpoint(tree.join(F.broadcast(hit), "node", "left_semi").select("sample").distinct())
            live = checkpoint(without_nodes(live, hit))
            tree = checkpoint(tree.join(dirty, KEYS, "left_anti").unionByName(dominators(live.join(dirty, KEYS, "left_semi"), seeds, keys=KEYS)))
    return spark.createDataFrame(plan, "rank int, node long, gain long, worlds int, left long")
