"""Which nodes to block: heuristics, sample-average planners over dominator trees, exact evaluation on small graphs.

Planners take ``live(sample, src, dst)``, the live arcs of what the seeds reach in each world (``diffusion.worlds_from``); arcs of nodes that aren't reached do no harm.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.functions.rng import uniform
from diffspark.operators.dominators import ancestors, dominators, plans, undominated, without_nodes
from diffspark.operators.exact import frontier_spread
from diffspark.operators.graph import degrees, explore, pagerank, reach, top


def random_blocker(edges: DataFrame, seeds: DataFrame, k: int, *, seed: int = 7) -> DataFrame:
    nodes = degrees(edges).select("node").join(seeds, "node", "left_anti")
    return top(nodes.withColumn("score", uniform(seed, F.lit("block"), "node")), k, F.col("score"), F.col("node"))


def degree_blocker(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    return top(degrees(edges).join(seeds, "node", "left_anti"), k, F.col("deg").desc(), F.col("node"))


def pagerank_blocker(edges: DataFrame, seeds: DataFrame, k: int, *, iterations: int = 20) -> DataFrame:
    ranked = pagerank(edges, iterations=iterations).withColumn("rank", F.round("rank", 9))
    return top(ranked.join(seeds, "node", "left_anti"), k, F.col("rank").desc(), F.col("node"))


def proximity_blocker(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Nearest to the seeds first, then of larger degree, then of lower id; nodes that can't be reached are left out."""
    near = reach(edges, seeds).join(degrees(edges), "node").join(seeds, "node", "left_anti")
    return top(near.select("node", "dist", "deg"), k, F.col("dist"), F.col("deg").desc(), F.col("node"))


def reach_blocker(edges: DataFrame, reached: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Number of worlds in which ``reached(sample, node)`` has it, times (1 + degree): node, cnt, deg, score."""
    counts = reached.groupBy("node").agg(F.count("*").alias("cnt"))
    rows = counts.join(seeds, "node", "left_anti").join(degrees(edges), "node")
    return top(rows.select("node", "cnt", "deg", (F.col("cnt") * (1 + F.col("deg"))).alias("score")), k, F.col("score").desc(), F.col("node"))


def block_gains(live: DataFrame, seeds: DataFrame, *, blocked: list[int] | None = None, with_sources: bool = False) -> DataFrame:
    """What blocking each node alone would save in each world: sample, node, gain; with_sources: seeds too, less the seed itself (cutting all its arcs). A node saves what it dominates."""
    if blocked:
        live, seeds = live.where(~F.col("src").isin(blocked) & ~F.col("dst").isin(blocked)), seeds.where(~F.col("node").isin(blocked))
    tree = dominators(live, seeds, keys=["sample"])
    rows = tree if with_sources else tree.where("not seed")
    return rows.select("sample", "node", (F.col("size") - F.col("seed").cast("long")).alias("gain"))


def advanced_greedy(live: DataFrame, seeds: DataFrame, k: int, *, refresh_every: int = 1) -> DataFrame:
    """Pick k nodes one after another by the total gain over all worlds, ties to the lower id, until nothing is gained: rank, node, gain (sum over worlds).

    refresh_every: picks after which the worlds that they changed are looked at anew. Between them gains are those of the stored dominator trees, less what is saved already: at most the true ones, for a fraction of the work; with 0 they are never renewed.
    """
    return plans(live, seeds, k, keys=["sample"], refresh_every=refresh_every)


def scored_pick(live: DataFrame, seeds: DataFrame, samples: int, score: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The best node by ``score`` of its gains in each world, whatever the score: rank, node, gain."""
    best = top(score(block_gains(live, seeds), samples), 1, F.col("gain").desc(), F.col("node"))
    return best.select(F.lit(1).alias("rank"), "node", F.col("gain").cast("double").alias("gain"))


def lower_bound(z: float) -> Callable[[DataFrame, int], DataFrame]:
    """Score by mean less z standard errors; worlds in which a node isn't reached count as 0."""

    def score(gains: DataFrame, samples: int) -> DataFrame:
        mean, square = F.sum("gain") / samples, F.sum(F.col("gain") * F.col("gain")) / samples
        error = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean) / max(samples - 1, 1))
        return gains.groupBy("node").agg(F.round(mean - z * error, 9).alias("gain"))

    return score


def cross_validated(top_k: int) -> Callable[[DataFrame, int], DataFrame]:
    """Score by the second half of the worlds, of the ``top_k`` best nodes of the first half only, so that no node is judged by the worlds that made it stand out."""

    def score(gains: DataFrame, samples: int) -> DataFrame:
        half = samples // 2
        first, second = (F.coalesce(F.sum(F.when(c, F.col("gain"))), F.lit(0)) for c in (F.col("sample") < half, F.col("sample") >= half))
        return top(gains.groupBy("node").agg(first.alias("a"), second.cast("double").alias("gain")), top_k, F.col("a").desc(), F.col("node")).select("node", "gain")

    return score


def control_variate_gains(live: DataFrame, seeds: DataFrame, arcs: DataFrame, samples: int, *, shrink: float = 5.0) -> DataFrame:
    """Mean saving of blocking each node, that of the seeds' neighbours corrected by whether a seed's arc to them is live, whose chance is known: node, gain.

    The slope of a neighbour's saving over that event is shrunk towards the pooled slope of all neighbours, by the weight ``shrink`` against the number of worlds.
    """
    gains = checkpoint(block_gains(live, seeds))
    from_seeds = arcs.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").join(seeds.withColumnRenamed("node", "dst"), "dst", "left_anti")
    chance = from_seeds.groupBy(F.col("dst").alias("node")).agg((-F.expm1(F.sum(F.log1p(-F.least(F.lit(1 - 1e-12), F.col("p")))))).alias("q"))
    hits = live.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select("sample", F.col("dst").alias("node")).distinct().withColumn("hit", F.lit(1))
    sums = gains.join(hits, ["sample", "node"], "left").groupBy("node").agg(F.sum("gain").alias("g"), F.sum(F.col("gain") * F.coalesce("hit", F.lit(0))).alias("gh"))
    rows = chance.join(sums, "node", "left").join(hits.groupBy("node").agg(F.sum("hit").alias("h")), "node", "left").na.fill(0, ["g", "gh", "h"])
    rows = checkpoint(rows.withColumn("cov", (F.col("gh") - F.col("g") * F.col("h") / samples) / (samples - 1)).withColumn("var", (F.col("h") - F.col("h") * F.col("h") / samples) / (samples - 1)))
    whole = rows.agg(F.sum("cov").alias("cov"), F.sum("var").alias("var")).first()
    pooled = (whole["cov"] or 0.0) / max(whole["var"] or 0.0, 1e-12)
    slope = (samples * F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0) + shrink * pooled) / (samples + shrink)
    near = rows.select("node", F.greatest(F.lit(0.0), F.col("g") / samples - slope * (F.col("h") / samples - F.col("q"))).alias("gain"))
    return near.union(sums.join(rows, "node", "left_anti").select("node", (F.col("g") / samples).alias("gain")))


def cost_aware_plan(live: DataFrame, seeds: DataFrame, arcs: DataFrame, budget: int) -> DataFrame:
    """Greedy moves by what they save for each blocked node: a single node, or all free out-neighbours of a seed at once, which cuts it off: move, node, ratio (sum over worlds).

    Blocking one by one can't see a cut whose nodes save little alone. A round brings back its best node, a row for each seed, and the nodes of the move.
    """
    plan, left, move = [], budget, 0
    starts = {r["node"] for r in seeds.select("node").distinct().collect()}
    around = checkpoint(arcs.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").distinct())
    while left > 0:
        gone = [n for _, n, _ in plan]
        gains = checkpoint(block_gains(live, seeds, blocked=gone, with_sources=True).groupBy("node").agg(F.sum("gain").alias("gain")))
        best = gains.where(~F.col("node").isin(starts)).orderBy(F.col("gain").desc(), "node").first()
        ratio, nodes = (float(best["gain"]), [best["node"]]) if best and best["gain"] > 0 else (0.0, [])
        free = around.where(~F.col("dst").isin([*starts, *gone]))
        costs = free.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("cost"))
        for r in gains.join(costs, "node").where((F.col("cost") <= left) & (F.col("gain") > 0)).orderBy("node").collect():
            if r["gain"] / r["cost"] > ratio:
                ratio, nodes = r["gain"] / r["cost"], sorted(x["dst"] for x in free.where(F.col("src") == r["node"]).collect())
        if not nodes:
            break
        move += 1
        plan += [(move, n, ratio) for n in nodes]
        left -= len(nodes)
    return live.sparkSession.createDataFrame(plan, "move int, node long, ratio double")


def greedy_replace(live: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Fill from the seeds' live out-neighbours, top up from all nodes, then take back each pick, latest first, and put the best node in its place, until one is its own best: rank, node, gain."""
    near = checkpoint(live.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
    plan: list[tuple[int, int]] = []

    def best(pool: DataFrame | None, blocked: list[int]):
        totals = block_gains(live, seeds, blocked=blocked).groupBy("node").agg(F.sum("gain").alias("gain"))
        if pool is not None:
            totals = totals.join(pool, "node", "left_semi")
        return totals.orderBy(F.col("gain").desc(), "node").first()

    for pool in (near, None):
        while len(plan) < k and (row := best(pool, [p[0] for p in plan])) and row["gain"] > 0:
            plan.append((row["node"], row["gain"]))
    for i in reversed(range(len(plan))):
        row = best(None, [p[0] for j, p in enumerate(plan) if j != i])
        same = row is None or row["node"] == plan[i][0]
        if row is not None:
            plan[i] = (row["node"], row["gain"])
        if same:
            break
    return live.sparkSession.createDataFrame([(i + 1, n, g) for i, (n, g) in enumerate(plan)], "rank int, node long, gain long")


def max_coverage(live: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Greedy maximum coverage of dominated nodes on fixed worlds: rank, node, gain (newly covered). Subtrees of a dominator tree lie within each other or apart, so a pick only lowers the sizes above it."""
    return plans(live, seeds, k, keys=["sample"], refresh_every=0)


def isolation(live: DataFrame, seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """Gain for cost of blocking a node (cost 1) or cutting a seed off (cost: its out-neighbours): node, is_source, gain, cost, ratio."""
    gains = block_gains(live, seeds, with_sources=True).groupBy("node").agg(F.sum("gain").alias("gain"))
    cost = arcs.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    rows = gains.join(cost, "node", "left")
    return rows.select("node", F.col("out").isNotNull().alias("is_source"), "gain", F.coalesce("out", F.lit(1)).alias("cost"), (F.col("gain") / F.coalesce("out", F.lit(1))).alias("ratio"))


def greedy_by_removal(live: DataFrame, seeds: DataFrame, samples: int, k: int) -> DataFrame:
    """Greedy by what is reached without each candidate: rank, node, spread after (sum over worlds, seeds included).

    Removing a node changes what is reached in the worlds that reach it alone, and there below it alone in a spanning tree. So all (candidate, world) pairs advance together, each over its own subtree (``removal_losses``).
    """
    plan, keys = [], ["sample"]
    starts = checkpoint(seeds.select("node", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")))
    for rank in range(1, k + 1):
        gone = live.sparkSession.createDataFrame([(p[1],) for p in plan], "node long")
        arcs = checkpoint(without_nodes(live, gone)) if plan else live
        tree, total = counted(explore(arcs, starts, keys=keys)[0])
        losses = removal_losses(tree, arcs, keys).join(seeds, "node", "left_anti")
        best = losses.groupBy("node").agg(F.sum("lost").alias("lost")).orderBy(F.col("lost").desc(), "node").first()
        if best is None:
            break
        plan.append((rank, best["node"], total - best["lost"]))
    return live.sparkSession.createDataFrame(plan, "rank int, node long, spread long")


def removal_losses(tree: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """How many nodes of a world's spanning ``tree(*keys, node, parent)`` are not reached any more without each of its nodes, itself included: keys, node, lost. Those below a node are walked from arcs that come from elsewhere; rows are as many as the trees' depths together."""
    own = checkpoint(live.select(*keys, "src", "dst").join(tree.select(*keys, F.col("node").alias("src")), [*keys, "src"], "left_semi"))
    pairs = checkpoint(ancestors(tree, keys))
    lost = pairs.join(undominated(pairs, own, keys), [*keys, "cut", "node"], "left_anti").select(*keys, F.col("cut").alias("node"))
    return lost.unionByName(tree.select(*keys, "node")).groupBy(*keys, "node").agg(F.count("*").alias("lost"))


def best_swaps(live: DataFrame, seeds: DataFrame, plan: DataFrame, *, least: float = 0.002, passes: int = 20) -> DataFrame:
    """Improve a plan by exchanging one node for a better one, as long as the total gain grows by the share ``least``: rank, node, gain of the node given the others."""
    nodes = [r["node"] for r in plan.orderBy("rank").collect()]
    own = [0] * len(nodes)
    for _ in range(passes):
        moved = False
        for i in range(len(nodes)):
            totals = block_gains(live, seeds, blocked=nodes[:i] + nodes[i + 1 :]).groupBy("node").agg(F.sum("gain").alias("gain"))
            totals = checkpoint(totals)
            rows = {r["node"]: r["gain"] for r in top(totals, 1, F.col("gain").desc(), F.col("node")).union(totals.where(F.col("node") == nodes[i])).collect()}
            node = max(rows, key=lambda v: (rows[v], -v), default=nodes[i])
            now = rows.get(nodes[i], 0)
            own[i] = now
            if node != nodes[i] and rows[node] > now * (1 + least):
                nodes[i], own[i], moved = node, rows[node], True
        if not moved:
            break
    return live.sparkSession.createDataFrame([(i + 1, n, g) for i, (n, g) in enumerate(zip(nodes, own, strict=True))], "rank int, node long, gain long")


def exact_spread(graphs: DataFrame) -> DataFrame:
    """Expected number of nodes reached, seeds left out, of small graphs ``(graph_id, edges array<struct<u, v, p>>, seeds array, blocked array)`` with one coin for each edge: graph_id, spread. Not by their 2^m worlds, but by ``exact.frontier_spread``."""
    return frontier_spread(graphs)


def min_vertex_cut(arcs: list[tuple[int, int]], seeds: list[int], target: int) -> list[int]:
    """Fewest nodes, none a seed or the target, that part the seeds from the target; none if an arc joins them directly. Augmenting paths on split nodes, with flow on arcs cancelled where a path goes back."""
    out: dict[tuple, dict[tuple, int]] = {}

    def arc(a, b, c):
        out.setdefault(a, {}).setdefault(b, 0)
        out.setdefault(b, {}).setdefault(a, 0)
        out[a][b] += c

    big, own = 1 << 30, set(seeds)
    for v in {x for e in arcs for x in e}:
        arc((v, 0), (v, 1), big if v in own or v == target else 1)
    for u, v in arcs:
        arc((u, 1), (v, 0), big)
    for s in own:
        arc(("s", 0), (s, 0), big)
    source, sink = ("s", 0), (target, 0)

    def found():
        back, queue = {source: None}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in out.get(a, {}).items():
                if c > 0 and b not in back:
                    back[b] = a
                    queue.append(b)
        return back

    while sink in (back := found()):
        path, b = [], sink
        while back[b] is not None:
            path.append((back[b], b))
            b = back[b]
        push = min(out[a][b] for a, b in path)
        if push >= big:
            return []
        for a, b in path:
            out[a][b] -= push
            out[b][a] += push
    side = found()
    return sorted(a[0] for a in side if a[1] == 0 and a[0] != "s" and a[0] not in own and (a[0], 1) not in side)


def world_cuts(live: DataFrame, seeds: DataFrame, targets: list[int]) -> DataFrame:
    """Minimum vertex cuts between the seeds and each target in each world: sample, target, cut (sorted; empty where the target isn't reached or is next to a seed). A group is one world's reachable arcs."""
    starts = [r["node"] for r in seeds.select("node").collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs = sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        rows = [(int(pdf["sample"].iloc[0]), t, min_vertex_cut(arcs, starts, t)) for t in targets]
        return pd.DataFrame(rows, columns=["sample", "target", "cut"])

    return live.groupBy("sample").applyInPandas(run, "sample int, target long, cut array<long>")
