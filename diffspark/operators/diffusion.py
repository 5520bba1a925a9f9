"""Diffusion models over ``edges(src, dst)``: probabilities, live worlds, cascades, epidemics, competing campaigns."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.functions.rng import normal, uniform
from diffspark.operators.graph import SENT, Dealt, degrees, explore, reach


def edge_probabilities(edges: DataFrame, model: str, *, p: float = 0.1, seed: int = 7) -> DataFrame:
    """Arcs with p: ``wc`` (1 / degree of the target), ``const``, ``tri`` (.1, .01 or .001, drawn for each arc) or ``bimodal`` (.9 with chance ``p``, else .05)."""
    u = uniform(seed, "src", "dst")
    if model == "wc":
        return edges.join(degrees(edges).withColumnRenamed("node", "dst"), "dst").select("src", "dst", (1 / F.col("deg")).alias("p"))
    value: dict[str, Column] = {
        "const": F.lit(float(p)),
        "tri": F.when(u < 1 / 3, 0.1).when(u < 2 / 3, 0.01).otherwise(0.001),
        "bimodal": F.when(u < p, 0.9).otherwise(0.05),
    }
    return edges.select("src", "dst", value[model].alias("p"))


def scaled(arcs: DataFrame, factor: float | Column) -> DataFrame:
    return arcs.withColumn("p", F.least(F.lit(1.0), F.col("p") * factor))


def live_arcs(arcs: DataFrame, samples: int, *, seed: int = 7, undirected: bool = False) -> DataFrame:
    """Live arcs of ``samples`` worlds: sample, src, dst; a coin for each arc, or one shared by both directions of an edge."""
    ends = ("src", "dst") if not undirected else (F.least("src", "dst"), F.greatest("src", "dst"))
    worlds = arcs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return worlds.where(uniform(seed, "sample", *ends) < F.col("p")).select("sample", "src", "dst")


def worlds_from(arcs: DataFrame, seeds: DataFrame, samples: int, *, first: int = 0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """What the seeds reach in each world from ``first`` on (sample, node, dist, parent), and the live arcs that leave it (sample, src, dst). Coins are those of ``live_arcs``, thrown only where a cascade meets an arc."""
    starts = seeds.select("node", F.explode(F.sequence(F.lit(first), F.lit(samples - 1))).alias("sample"))
    return explore(arcs.select("src", "dst", "p"), starts, keys=["sample"], coin=uniform(seed, "sample", "src", "dst") < F.col("p"), met=True)


def cascade_reach(live: DataFrame, seeds: DataFrame, samples: int, *, blocked: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes reached in each world, seeds included, blocked nodes and seeds left out: sample, node, dist."""
    if blocked is not None:
        live = live.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti").join(blocked.select(F.col("node").alias("src")), "src", "left_anti")
        seeds = seeds.join(blocked, "node", "left_anti")
    starts = seeds.select("node", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return reach(live, starts, keys=["sample"], max_depth=max_depth)


def expected_spread(live: DataFrame, seeds: DataFrame, samples: int, **options) -> DataFrame:
    """One row: spread, the mean number of reached nodes over all worlds, seeds included."""
    return cascade_reach(live, seeds, samples, **options).agg((F.count("*") / samples).alias("spread"))


def log_normal_rate(beta: float, sigma: float, seed: int, *keys) -> Column:
    return F.exp(F.log(F.lit(beta)) + sigma * normal(seed, *keys))


def sir_times(edges: DataFrame, outbreaks: DataFrame, *, horizon: float, seed: int = 7, recovery: float = 1.0) -> DataFrame:
    """Infection and recovery times up to ``horizon`` of ``outbreaks(sim_id, source, beta)``: sim_id, node, inf_time, rec_time.

    Each node's infectious time and each arc's delay are drawn once, by hash; an arc transmits if its delay is shorter than its source's infectious time, and a node's infection time is its shortest path from the source. The paths are relaxed for all outbreaks at once, a join for each round, over the nodes whose time fell in the round before.
    """
    def period(node: str) -> Column:
        return -F.log(1 - uniform(seed, F.lit("rec"), "sim_id", node)) / recovery

    known = checkpoint(outbreaks.select("sim_id", F.col("source").alias("node"), "beta", F.lit(0.0).alias("t")))
    front = known
    while True:
        step = front.withColumnRenamed("node", "src").join(edges, "src")
        delay = -F.log(1 - uniform(seed, F.lit("arc"), "sim_id", "src", "dst")) / F.col("beta")
        step = step.withColumn("delay", delay).where(F.col("delay") < period("src")).withColumn("t", F.col("t") + F.col("delay")).where(F.col("t") <= horizon)
        best = step.groupBy("sim_id", F.col("dst").alias("node"), "beta").agg(F.min("t").alias("new"))
        joined = best.join(known.select("sim_id", "node", F.col("t").alias("old")), ["sim_id", "node"], "left")
        front = checkpoint(joined.where(F.col("old").isNull() | (F.col("new") < F.col("old"))).select("sim_id", "node", "beta", F.col("new").alias("t")))
        if front.isEmpty():
            break
        known = checkpoint(known.unionByName(front).groupBy("sim_id", "node", "beta").agg(F.min("t").alias("t")))
    return known.select("sim_id", "node", F.col("t").alias("inf_time"), (F.col("t") + period("node")).alias("rec_time"))


def snapshot(times: DataFrame, at: float) -> DataFrame:
    """States at a time, susceptible nodes left out: sim_id, node, state (1 infectious, 2 recovered)."""
    return times.where(F.col("inf_time") <= at).select("sim_id", "node", F.when(F.col("rec_time") <= at, 2).otherwise(1).alias("state"))


def outbreaks(nodes: DataFrame, sims_per_node: int, *, beta: float, sigma: float = 0.0, seed: int = 7) -> DataFrame:
    """``sims_per_node`` outbreaks from each node: sim_id, source, beta."""
    runs = nodes.select(F.col("node").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(sims_per_node - 1))).alias("run"))
    rate = F.lit(beta) if not sigma else log_normal_rate(beta, sigma, seed, F.lit("beta"), "source", "run")
    return runs.select((F.col("source") * sims_per_node + F.col("run")).alias("sim_id"), "source", rate.alias("beta"))


def competing(live: DataFrame, bad: DataFrame, good: DataFrame, samples: int, *, delay: int = 0, max_rounds: int = 1000) -> DataFrame:
    """Two campaigns in live worlds: sample, node, round, campaign ('good' or 'bad').

    In a round the good campaign moves first and so wins ties; its seeds enter in round ``delay``, where nothing has been before. A node keeps the campaign that reaches it first.
    """
    worlds = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    late = good.select("node", worlds)
    state = bad.select("node", worlds).select("sample", "node", F.lit(0).alias("round"), F.lit("bad").alias("campaign"))
    if delay == 0:
        state = late.select("sample", "node", F.lit(0).alias("round"), F.lit("good").alias("campaign")).unionByName(state.join(late, ["sample", "node"], "left_anti"))
    state = front = checkpoint(state)
    for turn in range(1, max_rounds + 1):
        step = front.select("sample", F.col("node").alias("src"), "campaign").join(live, ["sample", "src"]).select("sample", F.col("dst").alias("node"), "campaign")
        if turn == delay:
            step = step.unionByName(late.select("sample", "node", F.lit("good").alias("campaign")))
        # 'good' sorts after 'bad', so the larger name wins the round.
        won = step.groupBy("sample", "node").agg(F.max("campaign").alias("campaign"))
        front = checkpoint(won.join(state, ["sample", "node"], "left_anti").withColumn("round", F.lit(turn)).select("sample", "node", "round", "campaign"))
        if front.isEmpty() and turn >= delay:
            break
        state = checkpoint(state.unionByName(front))
    return state


def episodes(arcs: DataFrame, cascades: DataFrame, *, seed: int = 7, max_rounds: int | None = 60, blocked: DataFrame | None = None, throttled: DataFrame | None = None) -> DataFrame:
    """Activations of ``cascades(cascade, kappa, node)`` round by round: cascade, node, round.

    An arc is live if its uniform, fixed for the cascade, is below min(1, kappa * p), times rho of its source where ``throttled(cascade, node, rho)`` has it; ``blocked(cascade, node, from_round)`` keeps nodes out from a round on. ``max_rounds`` None: until nothing new is hit. All policies on one cascade share their coins.
    """
    kappa = cascades.select("cascade", "kappa").distinct()
    dealt = Dealt(arcs, ["src"])
    front, size = counted(cascades.select("cascade", "node", F.lit(0).alias("round")))
    state, total = front, size
    for turn in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        heads = front.select("cascade", F.col("node").alias("src")).join(kappa, "cascade")
        step = (F.broadcast(heads) if size <= SENT else heads).join(dealt.around(heads, size), "src")
        rate = F.least(F.lit(1.0), F.col("kappa") * F.col("p"))
        if throttled is not None:
            step = step.join(throttled.select("cascade", F.col("node").alias("src"), "rho"), ["cascade", "src"], "left")
            rate = rate * F.coalesce("rho", F.lit(1.0))
        step = step.where(uniform(seed, "cascade", "src", "dst") < rate).select("cascade", F.col("dst").alias("node")).distinct()
        if blocked is not None:
            step = step.join(blocked.where(F.col("from_round") <= turn), ["cascade", "node"], "left_anti")
        before = state.select("cascade", "node")
        front, size = counted(step.join(F.broadcast(before) if total <= SENT else before, ["cascade", "node"], "left_anti").withColumn("round", F.lit(turn)))
        if not size:
            break
        state, total = state.unionByName(front), total + size
        if turn % 8 == 0:
            state = checkpoint(state)
    dealt.unpersist()
    return state
