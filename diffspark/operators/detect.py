"""Source detectors: scores of the infected nodes of ``snapshots(sim_id, node, state)``, larger for likelier sources. Nodes that can't be the source have no row."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint
from diffspark.operators.graph import induced, pairwise_hops

SCORES = "sim_id long, node long, score double"


def random(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Minus the log of the number of infected."""
    return snapshots.select("sim_id", "node", (-F.log(F.count("*").over(W.partitionBy("sim_id")))).alias("score"))


def degree(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Infected neighbours."""
    near = induced(edges, snapshots, ["sim_id"]).groupBy("sim_id", F.col("src").alias("node")).agg(F.count("*").alias("k"))
    return snapshots.join(near, ["sim_id", "node"], "left").select("sim_id", "node", F.coalesce("k", F.lit(0)).cast("double").alias("score"))


def _hops(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each infected root: far (largest hop count within the infected graph), total, reached, n_inf."""
    hops = pairwise_hops(edges, snapshots.select("sim_id", "node"), ["sim_id"])
    sizes = snapshots.groupBy("sim_id").agg(F.count("*").alias("n_inf"))
    return hops.groupBy("sim_id", F.col("root").alias("node")).agg(F.max("dist").alias("far"), F.sum("dist").alias("total"), F.count("*").alias("reached")).join(sizes, "sim_id")


def jordan(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Minus the eccentricity among the infected; 1000 for each that can't be reached."""
    return _hops(edges, snapshots).select("sim_id", "node", (-(F.col("far") + 1000 * (F.col("n_inf") - F.col("reached")))).cast("double").alias("score"))


def distance(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Minus the sum of distances; 1000 for each that can't be reached."""
    return _hops(edges, snapshots).select("sim_id", "node", (-(F.col("total") + 1000 * (F.col("n_inf") - F.col("reached")))).cast("double").alias("score"))


def closeness(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Closeness within the infected graph, scaled by the reached share."""
    r = F.col("reached") - 1
    value = F.when((F.col("total") > 0) & (F.col("n_inf") > 1), r / F.col("total") * r / (F.col("n_inf") - 1)).otherwise(0.0)
    return _hops(edges, snapshots).select("sim_id", "node", value.alias("score"))


def by_outbreak(kernel: Callable[[np.ndarray, list[list[int]]], np.ndarray]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A detector from a kernel over one outbreak: its infected nodes, and their sorted infected neighbours by position, to scores. Outbreaks are independent groups; a group is one outbreak's infected graph."""

    def detector(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
        inner = induced(edges, snapshots, ["sim_id"]).groupBy("sim_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("near"))
        rows = snapshots.select("sim_id", "node").join(inner, ["sim_id", "node"], "left")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            nodes = pdf["node"].to_numpy()
            at = {v: i for i, v in enumerate(nodes.tolist())}
            near = [[at[v] for v in x] if x is not None else [] for x in pdf["near"]]
            out = pd.DataFrame({"sim_id": pdf["sim_id"].to_numpy(), "node": nodes, "score": kernel(nodes, near)})
            return out[np.isfinite(out["score"])]

        return rows.groupBy("sim_id").applyInPandas(run, SCORES)

    return detector


def _betweenness(nodes: np.ndarray, near: list[list[int]]) -> np.ndarray:
    """Share of shortest paths between others that pass a node: one breadth-first search for each root, dependencies summed backwards."""
    n, out = len(nodes), np.zeros(len(nodes))
    for root in range(n):
        dist, paths, order = [-1] * n, [0.0] * n, []
        dist[root], paths[root] = 0, 1.0
        queue = deque([root])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in near[u]:
                if dist[v] < 0:
                    dist[v] = dist[u] + 1
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        owed = [0.0] * n
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    owed[u] += paths[u] / paths[v] * (1 + owed[v])
            if v != root:
                out[v] += owed[v]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def _rumor(nodes: np.ndarray, near: list[list[int]]) -> np.ndarray:
    """log n! less the logs of the subtree sizes of a root's breadth-first tree, where a node's parent is the one that finds it first, neighbours going in order of id; no score for a root that doesn't reach all."""
    n = len(nodes)
    log_factorial, out = np.log(np.arange(1, n + 1)).sum(), np.full(n, -np.inf)
    for root in range(n):
        parent, order, queue = {root: -1}, [], deque([root])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in near[u]:
                if v not in parent:
                    parent[v] = u
                    queue.append(v)
        if len(order) < n:
            continue
        size = np.ones(n)
        for v in reversed(order[1:]):
            size[parent[v]] += size[v]
        out[root] = log_factorial - np.log(size).sum()
    return out


betweenness, rumor = by_outbreak(_betweenness), by_outbreak(_rumor)


def netsleuth(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Magnitude of the smallest eigenvector of the infected rows and columns of the whole graph's Laplacian; 0 for a single infected node."""
    full = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    inner = induced(edges, snapshots, ["sim_id"]).groupBy("sim_id", F.col("src").alias("node")).agg(F.collect_list("dst").alias("near"))
    rows = snapshots.select("sim_id", "node").join(full, "node", "left").join(inner, ["sim_id", "node"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes = pdf["node"].to_numpy()
        at = {v: i for i, v in enumerate(nodes.tolist())}
        m = np.diag(pdf["deg"].fillna(0).to_numpy(float))
        for i, x in enumerate(pdf["near"]):
            for v in x if x is not None else []:
                m[i, at[v]] -= 1
        score = np.abs(np.linalg.eigh(m)[1][:, 0]) if len(nodes) > 1 else np.zeros(1)
        return pd.DataFrame({"sim_id": pdf["sim_id"].to_numpy(), "node": nodes, "score": score})

    return rows.groupBy("sim_id").applyInPandas(run, SCORES)


def monte_carlo(train: DataFrame, sims: DataFrame, snapshots: DataFrame, n_nodes: int) -> DataFrame:
    """Sum of log smoothed state frequencies of each candidate source over the whole snapshot.

    ``train(source, node, state)`` holds the states of training outbreaks, ``sims(source, sims)`` their number for each source. A node's frequency in a state is (count + 1) / (sims + 3), and the source itself, never susceptible, has one susceptible outbreak less. Susceptible counts are what the others leave, so only infected rows are stored: a candidate's sum over all nodes as susceptible is taken once, and corrected at the infected ones.
    """
    seen = train.groupBy("source", "node").agg(F.count_if(F.col("state") == 1).alias("c1"), F.count_if(F.col("state") == 2).alias("c2")).join(sims, "source")
    own = (F.col("source") == F.col("node")).cast("int")
    log_s = F.log((F.col("sims") - F.col("c1") - F.col("c2") + 1 - own) / (F.col("sims") + 3))
    seen = seen.select("source", "node", "sims", "c1", "c2", log_s.alias("log_s"))
    rest = F.log((F.col("sims") + 1) / (F.col("sims") + 3))
    whole = seen.groupBy("source", "sims").agg(F.sum("log_s").alias("known"), F.count("*").alias("k"))
    whole = whole.select(F.col("source").alias("candidate"), "sims", (F.coalesce("known", F.lit(0.0)) + (n_nodes - F.col("k")) * rest).alias("all_s"))
    pairs = snapshots.select("sim_id", F.col("node").alias("candidate")).join(whole, "candidate")
    cells = pairs.join(snapshots, "sim_id").join(seen.select(F.col("source").alias("candidate"), "node", "c1", "c2", "log_s"), ["candidate", "node"], "left")
    count = F.coalesce(F.when(F.col("state") == 1, F.col("c1")).otherwise(F.col("c2")), F.lit(0))
    # A candidate's own susceptible count leaves nothing (log 0), which the sum over known nodes has left out.
    known = F.when(F.col("c1").isNotNull(), F.coalesce("log_s", F.lit(0.0))).otherwise(rest)
    gain = F.log((count + 1) / (F.col("sims") + 3)) - known
    return cells.groupBy("sim_id", F.col("candidate").alias("node")).agg((F.first("all_s") + F.sum(gain)).alias("score"))


def soft_margin(train: DataFrame, snapshots: DataFrame, *, width: float = 0.5) -> DataFrame:
    """Mean kernel exp(-(J - 1)^2 / width^2) of the Jaccard index J between a snapshot's infected set and those of each source's training outbreaks ``train(source, sim, node)``; sets that share nothing count with J = 0."""
    sizes = train.groupBy("source", "sim").agg(F.count("*").alias("size"))
    own = snapshots.groupBy("sim_id").agg(F.count("*").alias("n_inf"))
    common = snapshots.select("sim_id", "node").join(train, "node").groupBy("sim_id", "source", "sim").agg(F.count("*").alias("common"))
    j = F.col("common") / (F.col("size") + F.col("n_inf") - F.col("common"))
    kernel = F.exp(-((j - 1) ** 2) / width**2)
    per = common.join(sizes, ["source", "sim"]).join(own, "sim_id").groupBy("sim_id", "source").agg(F.sum(kernel).alias("k"), F.count("*").alias("met"))
    n = sizes.groupBy("source").agg(F.count("*").alias("n"))
    none = float(np.exp(-1 / width**2))
    out = per.join(n, "source").select("sim_id", F.col("source").alias("node"), ((F.col("k") + (F.col("n") - F.col("met")) * none) / F.col("n")).alias("score"))
    return out.join(snapshots.select("sim_id", "node"), ["sim_id", "node"], "left_semi")


def soft_margin_sweep(train: DataFrame, snapshots: DataFrame, *, widths: int = 15, jump: float = 0.05) -> DataFrame:
    """Log of the mean kernel of ``soft_margin``, with the narrowest width of 2^-1, 2^-2, ... that still gives a stable estimate: sim_id, node, score.

    Widths are tried from the widest on. The search ends, and keeps the width before, where all kernels vanish, or where the best source stays and its share of the sum moves by more than ``jump``; and it ends behind a width at which even the best source has next to nothing.
    """
    sizes = train.groupBy("source", "sim").agg(F.count("*").alias("size"))
    own = snapshots.groupBy("sim_id").agg(F.count("*").alias("n_inf"))
    common = snapshots.select("sim_id", "node").join(train, "node").groupBy("sim_id", "source", "sim").agg(F.count("*").alias("common"))
    j = F.col("common") / (F.col("size") + F.col("n_inf") - F.col("common"))
    met = common.join(sizes, ["source", "sim"]).join(own, "sim_id").select("sim_id", "source", j.alias("j"))
    a = F.pow(F.lit(0.5), F.col("k"))
    tried = met.select("sim_id", "source", "j", F.explode(F.sequence(F.lit(1), F.lit(widths))).alias("k"))
    sums = tried.groupBy("sim_id", "source", "k").agg(F.sum(F.exp(-((F.col("j") - 1) ** 2) / (a * a))).alias("s"), F.count("*").alias("met"))
    grid = own.select("sim_id").crossJoin(sizes.groupBy("source").agg(F.count("*").alias("n"))).select("*", F.explode(F.sequence(F.lit(1), F.lit(widths))).alias("k"))
    value = (F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.coalesce("met", F.lit(0))) * F.exp(-1 / (a * a))) / F.col("n")
    per = checkpoint(grid.join(sums, ["sim_id", "source", "k"], "left").select("sim_id", "source", "k", value.alias("v")))
    tops = per.groupBy("sim_id", "k").agg(F.sum("v").alias("total"), F.max("v").alias("best"), F.max(F.struct(F.round("v", 12).alias("r"), (-F.col("source")).alias("m"), "v")).alias("top"))
    order = W.partitionBy("sim_id").orderBy("k")
    tops = tops.select("sim_id", "k", "total", "best", F.col("top.m").alias("m"), F.try_divide("top.v", "total").alias("p"))
    moved = (F.col("m") == F.lag("m").over(order)) & (F.abs(F.col("p") - F.lag("p").over(order)) > jump)
    stop = ~F.coalesce(F.col("total") > 0, F.lit(False)) | F.coalesce(moved, F.lit(False)) | F.coalesce(F.lag("best").over(order) < 1e-12, F.lit(False))
    picked = tops.withColumn("stop", stop).groupBy("sim_id").agg((F.coalesce(F.min(F.when(F.col("stop"), F.col("k"))), F.lit(widths + 1)) - 1).alias("k"))
    out = per.join(picked, ["sim_id", "k"]).select("sim_id", F.col("source").alias("node"), F.log(F.greatest("v", F.lit(1e-300))).alias("score"))
    return out.join(snapshots.select("sim_id", "node"), ["sim_id", "node"], "left_semi")


def combined(monte: DataFrame, central: DataFrame, weight: float = 0.5) -> DataFrame:
    """Monte Carlo score plus ``weight`` times the Jordan score less its largest."""
    top = F.max("c").over(W.partitionBy("sim_id"))
    joined = monte.join(central.withColumnRenamed("score", "c"), ["sim_id", "node"])
    return joined.select("sim_id", "node", (F.col("score") + weight * (F.col("c") - top)).alias("score"))


DETECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"random": random, "degree": degree, "jordan": jordan, "distance": distance, "closeness": closeness, "betweenness": betweenness, "rumor": rumor, "netsleuth": netsleuth}
