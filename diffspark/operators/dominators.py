"""Dominator trees of what seeds reach, in many worlds at once, and how picks change them.

A node's dominators are those that every way from the seeds to it passes, itself included; blocking a node saves what it dominates. A tree is a table: keys, node, up (immediate dominator, null at the top), size (nodes dominated), enter and span (the node's subtree is the numbers from enter to enter + span - 1), seed.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.operators.graph import explore, reach

#: Arcs of a world, at most, that one task takes whole; larger worlds are worked on by joins.
MOST_ARCS = 200_000


def without_nodes(live: DataFrame, gone: DataFrame) -> DataFrame:
    """The arcs that neither begin nor end in ``gone(*some keys, node)``."""
    own = [c for c in gone.columns if c != "node"]
    for end in ("src", "dst"):
        live = live.join(gone.withColumnRenamed("node", end), [*own, end], "left_anti")
    return live


def roots_of(live: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """The seeds (*some keys, node) in each world of ``live`` that has arcs: keys, node. Seeds without keys stand in all worlds, which are as many as there are samples."""
    worlds = live.select(*keys).distinct()
    own = [k for k in keys if k in seeds.columns]
    seeds = seeds.select(*own, "node").distinct()
    return (worlds.join(seeds, own) if own else seeds.crossJoin(F.broadcast(worlds))).select(*keys, "node")


def dominators(live: DataFrame, seeds: DataFrame, *, keys: list[str], most_arcs: int = MOST_ARCS) -> DataFrame:
    """The dominator tree of each world: of up to ``most_arcs`` arcs in one task (``world_trees``), of more by joins (``joined_trees``)."""
    roots = roots_of(live, seeds, keys)
    large, n = counted(live.groupBy(*keys).agg(F.count("*").alias("arcs")).where(F.col("arcs") > most_arcs).select(*keys))
    if not n:
        return world_trees(live, roots, keys)
    small = world_trees(live.join(large, keys, "left_anti"), roots.join(large, keys, "left_anti"), keys)
    return small.unionByName(joined_trees(live.join(large, keys, "left_semi"), roots.join(large, keys, "left_semi"), keys))


def numbered_tree(starts: list[int], out: dict[int, list[int]]) -> dict[int, tuple[int | None, int, int]]:
    """Each reached node's immediate dominator, the number of nodes that it dominates, and its number in a walk down the dominator tree.

    Nodes are numbered by depth-first postorder from a common source before all starts; dominators are found by intersecting predecessors' paths up to a fixed point.
    """
    order, seen = [], set()
    for s in starts:
        if s in seen:
            continue
        seen.add(s)
        stack = [(s, iter(out.get(s, ())))]
        while stack:
            node, rest = stack[-1]
            for v in rest:
                if v not in seen:
                    seen.add(v)
                    stack.append((v, iter(out.get(v, ()))))
                    break
            else:
                stack.pop()
                order.append(node)
    number = {v: i for i, v in enumerate(order)}
    root = number[None] = len(order)
    before: dict[int, list] = {v: [] for v in order}
    for u in order:
        for v in out.get(u, ()):
            before[v].append(u)
    for s in starts:
        before[s].append(None)
    idom, changed = {None: None}, True
    while changed:
        changed = False
        for v in reversed(order):
            new, known = None, False
            for u in before[v]:
                if u not in idom:
                    continue
                if not known:
                    new, known = u, True
                    continue
                a, b = new, u
                while a != b:
                    if number[a] < number[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                new = a
            if known and (v not in idom or idom[v] != new):
                idom[v], changed = new, True
    sizes = dict.fromkeys(order, 1)
    for v in order:  # a node's dominator has a higher number
        if number[idom[v]] < root:
            sizes[idom[v]] += sizes[v]
    free, enter = {None: 0}, {}
    for v in reversed(order):  # a node comes after its dominator, and takes the next numbers below it
        enter[v] = free[idom[v]]
        free[idom[v]] += sizes[v]
        free[v] = enter[v] + 1
    return {v: (idom[v], sizes[v], enter[v]) for v in order}


def world_trees(live: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Trees of worlds that are small enough for a task each."""
    arcs = live.select(*keys, "src", "dst", F.lit(False).alias("top")).unionByName(roots.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("top")))
    names = [*keys, "node", "up", "size", "enter", "span", "seed"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        starts = sorted(set(pdf.loc[pdf["top"], "dst"].tolist()))
        own = pdf.loc[~pdf["top"]]
        for u, v in sorted(set(zip(own["src"].tolist(), own["dst"].tolist(), strict=True))):
            out.setdefault(u, []).append(v)
        tree, first = numbered_tree(starts, out), set(starts)
        key = [pdf[k].iloc[0] for k in keys]
        rows = [(*key, v, up, size, enter, size, v in first) for v, (up, size, enter) in tree.items()]
        return pd.DataFrame(rows, columns=names).astype({"up": "Int64"})

    kinds = dict(live.dtypes)
    return arcs.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", node long, up long, size long, enter long, span long, seed boolean")


def ancestors(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Every node of ``tree(*keys, node, parent)`` with each node above it: keys, cut, node, gap. Pointers are doubled: rounds grow as the logarithm of the depth, rows as the depths' sum."""
    jump = checkpoint(tree.where("parent is not null").select(*keys, "node", F.col("parent").alias("cut")))
    pairs, reach_of = jump.withColumn("gap", F.lit(1)), 1
    while True:
        # Pairs as far apart as reach_of reach as far again from where they end.
        further = pairs.withColumnRenamed("cut", "_at").join(jump.select(*keys, F.col("node").alias("_at"), "cut"), [*keys, "_at"])
        further, n = counted(further.select(*keys, "node", "cut", (F.col("gap") + reach_of).alias("gap")))
        if not n:
            return pairs.select(*keys, "cut", "node", "gap")
        pairs = checkpoint(pairs.unionByName(further))
        jump = pairs.where(F.col("gap") == 2 * reach_of).select(*keys, "node", "cut")
        reach_of *= 2


def undominated(pairs: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``pairs(*keys, cut, node)``, all nodes below some cuts in a spanning tree of what is reached, those that are reached without the cut as well: keys, cut, node.

    A way round the cut enters its subtree from outside, and goes on inside; so only subtrees are walked, of all cuts at once. ``live`` has arcs of reached nodes alone.
    """
    into = pairs.select(*keys, "cut", F.col("node").alias("dst")).join(live.select(*keys, "src", "dst"), [*keys, "dst"]).where(F.col("src") != F.col("cut"))
    outside = into.join(pairs.select(*keys, "cut", F.col("node").alias("src")), [*keys, "cut", "src"], "left_anti")
    starts = outside.select(*keys, "cut", F.col("dst").alias("node")).distinct()
    return reach(live.select(*keys, "src", "dst"), starts, keys=[*keys, "cut"], mask=pairs.select(*keys, "cut", "node")).drop("dist")


def joined_trees(live: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Trees of worlds of any size, by joins: a spanning tree, its ancestor pairs, and those of them that are no dominators (``undominated``). Rows are as many as the spanning trees' depths together."""
    tree = checkpoint(explore(live, roots, keys=keys)[0])
    live = checkpoint(live.join(tree.select(*keys, F.col("node").alias("src")), [*keys, "src"], "left_semi"))
    pairs = checkpoint(ancestors(tree, keys))
    over = checkpoint(pairs.join(undominated(pairs, live, keys), [*keys, "cut", "node"], "left_anti"))
    up = over.groupBy(*keys, "node").agg(F.min_by("cut", "gap").alias("up"))
    sizes = over.groupBy(*keys, F.col("cut").alias("node")).agg(F.count("*").alias("below"))
    rows = tree.select(*keys, "node").join(up, [*keys, "node"], "left").join(sizes, [*keys, "node"], "left").join(roots.withColumn("seed", F.lit(True)), [*keys, "node"], "left")
    rows = rows.select(*keys, "node", "up", (1 + F.coalesce("below", F.lit(0))).alias("size"), F.coalesce("seed", F.lit(False)).alias("seed"))
    before = F.sum("size").over(W.partitionBy(*keys, "up").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    rows = checkpoint(rows.withColumn("enter", F.coalesce(before, F.lit(0)) + F.col("up").isNotNull().cast("long")))
    # A node's number is the sum of the places along its way down.
    todo = rows.select(*keys, "node", F.col("up").alias("at"), "enter")
    while True:
        step = todo.select(*keys, F.col("node").alias("at"), F.col("at").alias("_at"), F.col("enter").alias("_enter"))
        todo, n = counted(todo.join(step, [*keys, "at"], "left").select(*keys, "node", F.col("_at").alias("at"), (F.col("enter") + F.coalesce("_enter", F.lit(0))).alias("enter")))
        if todo.where("at is not null").isEmpty():
            break
    return rows.drop("enter").join(todo.drop("at"), [*keys, "node"]).select(*keys, "node", "up", "size", "enter", F.col("size").alias("span"), "seed")


def lowered(tree: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """The trees once ``picks(*some keys, node)``, one for each world at most, are blocked, by what the trees know: what a pick dominates goes, and its dominators' sizes fall by as much. Dominators that nodes get because ways through the pick are gone are not found."""
    own = [c for c in picks.columns if c != "node"]
    hits = tree.join(picks, [*own, "node"], "left_semi").select(*keys, F.col("enter").alias("_enter"), F.col("span").alias("_span"), F.col("size").alias("_size"))
    rows = tree.join(hits, keys, "left")
    below = F.col("_enter").isNotNull() & F.col("enter").between(F.col("_enter"), F.col("_enter") + F.col("_span") - 1)
    above = F.col("_enter").isNotNull() & (F.col("enter") < F.col("_enter")) & (F.col("_enter") <= F.col("enter") + F.col("span") - 1)
    return rows.where(~below).withColumn("size", F.col("size") - F.when(above, F.col("_size")).otherwise(0)).select(*tree.columns)


def plans(live: DataFrame, seeds: DataFrame, k: int, *, keys: list[str], by: list[str] | None = None, refresh_every: int = 1, most_arcs: int = MOST_ARCS) -> DataFrame:
    """Greedy plans of ``k`` nodes for each value of ``by`` (some of the keys; none: one plan): by, rank, node, gain (sum over its worlds). Ties go to the lower id, and a plan ends when nothing is gained.

    After a pick the stored trees are lowered by joins, and only every ``refresh_every`` picks the worlds that a pick since then has changed are worked on anew; 1: gains are exact at each pick, 0: never (coverage of the first trees).
    """
    by = by or []
    tree = checkpoint(dominators(live, seeds, keys=keys, most_arcs=most_arcs))
    chosen, gone, dirty = [], [], []
    for rank in range(1, k + 1):
        totals = tree.where("not seed").groupBy(*by, "node").agg(F.sum("size").alias("gain")).where("gain > 0")
        if by:
            order = W.partitionBy(*by).orderBy(F.col("gain").desc(), "node")
            best = totals.withColumn("_place", F.row_number().over(order)).where("_place = 1")
        else:
            best = totals.orderBy(F.col("gain").desc(), "node").limit(1)
        best, n = counted(best.select(*by, F.lit(rank).alias("rank"), "node", "gain"))
        if not n:
            break
        chosen.append(best)
        if rank == k:
            break
        picks = best.select(*by, "node")
        gone.append(picks)
        dirty.append(tree.join(picks, [*by, "node"], "left_semi").select(*keys))
        if refresh_every and rank % refresh_every == 0:
            tree, live = renewed(tree, live, seeds, reduce(DataFrame.unionByName, gone), reduce(DataFrame.unionByName, dirty), keys=keys, most_arcs=most_arcs)
            gone, dirty = [], []
        else:
            tree = checkpoint(lowered(tree, picks, keys))
    if chosen:
        return reduce(DataFrame.unionByName, chosen)
    kinds = dict(live.dtypes)
    return live.sparkSession.createDataFrame([], ", ".join([*(f"{c} {kinds[c]}" for c in by), "rank int", "node long", "gain long"]))


def renewed(tree: DataFrame, live: DataFrame, seeds: DataFrame, gone: DataFrame, dirty: DataFrame, *, keys: list[str], most_arcs: int = MOST_ARCS) -> tuple[DataFrame, DataFrame]:
    """The exact trees once ``gone(*some keys, node)`` are blocked, of which only the worlds ``dirty`` are worked on anew, and the arcs without them."""
    live, dirty = checkpoint(without_nodes(live, gone)), checkpoint(dirty.distinct())
    return checkpoint(tree.join(dirty, keys, "left_anti").unionByName(dominators(live.join(dirty, keys, "left_semi"), seeds, keys=keys, most_arcs=most_arcs))), live
