"""Sequential tests on cascades, round by round, throttles and stream control, as window plans.

``exposure(cascade, round, node, k_idx, log1mq)``: nodes at risk in a round and the log of the chance, under the k-th factor, that they stay free; ``outcome`` 1 if the node was hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint
from diffspark.functions.rng import uniform
from diffspark.operators.graph import SENT, few
from diffspark.sources.graphs import numbered

CAP, FLOOR = 1 - 1e-12, 1e-300


def factor_grid(low: float, high: float, ratio: float) -> list[float]:
    """From ``low`` to ``high`` in equal ratios of at most 1 + ``ratio``."""
    n = math.ceil(math.log(high / low) / math.log1p(ratio)) + 1
    return [low * (high / low) ** (j / max(n - 1, 1)) for j in range(n)]


def _exposed(arcs: DataFrame, activations: DataFrame, grid: list[float]) -> tuple[DataFrame, list[str]]:
    """One row for each node at risk in a round: cascade, round, node, outcome, and a column of log1mq for each factor; the names of these. Activations are sent to the arcs if they are few (counted), so that arcs of other nodes are not shuffled."""
    sent = F.broadcast if activations.count() <= SENT else lambda df: df
    front = activations.select("cascade", F.col("node").alias("src"), (F.col("round") + 1).alias("round"))
    met = sent(front).join(arcs, "src")
    when = activations.select("cascade", F.col("node").alias("dst"), F.col("round").alias("hit_round"))
    open_ = met.join(sent(when), ["cascade", "dst"], "left").where(F.col("hit_round").isNull() | (F.col("hit_round") >= F.col("round")))
    sums = [F.sum(F.log1p(-F.least(F.lit(CAP), float(x) * F.col("p")))).alias(f"_{k}") for k, x in enumerate([1.0, *grid])]
    hit = F.max((F.coalesce(F.col("hit_round"), F.lit(-1)) == F.col("round")).cast("int"))
    return open_.groupBy("cascade", "round", F.col("dst").alias("node")).agg(hit.alias("outcome"), *sums), [f"_{k}" for k in range(len(sums))]


def exposures(arcs: DataFrame, activations: DataFrame, grid: list[float]) -> DataFrame:
    """The exposure table of ``activations(cascade, node, round)``: the nodes active since round r expose their inactive neighbours in round r + 1; k_idx 0 is the factor 1."""
    per, names = _exposed(arcs, activations, grid)
    # Rows for the factors only after the aggregation.
    return per.select("cascade", "round", "node", F.posexplode(F.array(*names)).alias("k_idx", "log1mq"), "outcome")


def _hit(log1mq: Column) -> Column:
    return F.log(F.greatest(F.lit(FLOOR), -F.expm1(log1mq)))


def evidence(arcs: DataFrame, activations: DataFrame, grid: list[float]) -> DataFrame:
    """``round_evidence`` of the ``exposures``: cascade, round, k_idx, llr. The factors stay columns of a node's row until rounds are summed up, so the exposure table is neither written nor sorted."""
    per, (null, *names) = _exposed(arcs, activations, grid)
    ratios = [F.sum(F.when(F.col("outcome") == 1, _hit(F.col(c)) - _hit(F.col(null))).otherwise(F.col(c) - F.col(null))).alias(c) for c in names]
    rounds = per.groupBy("cascade", "round").agg(*ratios)
    return rounds.select("cascade", "round", F.posexplode(F.array(*names)).alias("k_idx", "llr")).withColumn("k_idx", F.col("k_idx") + 1)


def round_evidence(exposure: DataFrame) -> DataFrame:
    """Log likelihood ratio of each round against factor 0: cascade, round, k_idx, llr."""
    rows = exposure.withColumn("hit", _hit(F.col("log1mq"))).withColumn("miss", F.col("log1mq"))
    null = [F.max(F.when(F.col("k_idx") == 0, F.col(c))).over(W.partitionBy("cascade", "round", "node")).alias(f"{c}0") for c in ("hit", "miss")]
    rows = rows.select("*", *null).where("k_idx > 0")
    ratio = F.when(F.col("outcome") == 1, F.col("hit") - F.col("hit0")).otherwise(F.col("miss") - F.col("miss0"))
    return rows.groupBy("cascade", "round", "k_idx").agg(F.sum(ratio).alias("llr"))


def running(*keys: str):
    return W.partitionBy(*keys).orderBy("round").rowsBetween(W.unboundedPreceding, 0)


def eprocess(evidence: DataFrame, n_factors: int, grid: list[float]) -> DataFrame:
    """Uniform mixture of the likelihood ratios: cascade, round, log_e, kappa_hat (posterior mean factor)."""
    total = evidence.select("cascade", "round", "k_idx", F.sum("llr").over(running("cascade", "k_idx")).alias("log_l"))
    top = total.withColumn("m", F.max("log_l").over(W.partitionBy("cascade", "round")))
    factor = F.element_at(F.array(*map(F.lit, grid)), F.col("k_idx").cast("int"))
    e = F.exp(F.col("log_l") - F.col("m"))
    return top.groupBy("cascade", "round").agg((F.first("m") + F.log(F.sum(e)) - math.log(n_factors)).alias("log_e"), (F.sum(e * factor) / F.sum(e)).alias("kappa_hat"))


def sprt(evidence: DataFrame, k_idx: int) -> DataFrame:
    return evidence.where(F.col("k_idx") == k_idx).select("cascade", "round", F.sum("llr").over(running("cascade", "k_idx")).alias("statistic"))


def cusum(evidence: DataFrame, k_idx: int) -> DataFrame:
    """max(0, previous + llr), which is the running sum less the least of 0 and its running minimum."""
    run = running("cascade")
    total = sprt(evidence, k_idx).withColumnRenamed("statistic", "c")
    return total.select("cascade", "round", (F.col("c") - F.least(F.lit(0.0), F.min("c").over(run))).alias("statistic"))


def growth(activations: DataFrame) -> DataFrame:
    """Rounds with activations: cascade, round, new, size (running)."""
    run = running("cascade")
    return activations.groupBy("cascade", "round").agg(F.count("*").alias("new")).select("cascade", "round", "new", F.sum("new").over(run).alias("size"))


def excess(exposure: DataFrame) -> DataFrame:
    """(observed - expected) / sqrt(max(expected, 1)), cumulated under factor 0."""
    per = exposure.where("k_idx = 0").groupBy("cascade", "round").agg(F.sum("outcome").alias("o"), F.sum(-F.expm1(F.col("log1mq"))).alias("x"))
    run = running("cascade")
    o, x = F.sum("o").over(run), F.sum("x").over(run)
    return per.select("cascade", "round", ((o - x) / F.sqrt(F.greatest(x, F.lit(1.0)))).alias("statistic"))


def alarms(statistic: DataFrame, column: str, threshold: float, *, strict: bool = False) -> DataFrame:
    """First round at (or, ``strict``, above) the threshold: cascade, alarm_round."""
    over = F.col(column) > threshold if strict else F.col(column) >= threshold
    return statistic.where(over).groupBy("cascade").agg(F.min("round").alias("alarm_round"))


def never(cascades: DataFrame) -> DataFrame:
    """No cascade has an alarm: cascade, alarm_round."""
    return cascades.select("cascade", F.lit(0).alias("alarm_round")).limit(0)


def immediate(cascades: DataFrame) -> DataFrame:
    """Each cascade has its alarm in its first round of evidence: cascade, alarm_round."""
    return cascades.select("cascade").distinct().withColumn("alarm_round", F.lit(1))


def calibrated_threshold(statistic: DataFrame, column: str, alpha: float) -> DataFrame:
    """One row: threshold, the ceil((m + 1)(1 - alpha))-th smallest of the m cascades' largest values (the largest at most)."""
    best = statistic.groupBy("cascade").agg(F.max(column).alias("v"))
    m = best.count()
    rank = min(m, math.ceil(round((m + 1) * (1 - alpha), 9)))
    return numbered(best, "v", "cascade").where(F.col("number") == rank - 1).select(F.col("v").alias("threshold"))


def features(activations: DataFrame, last_round: int) -> DataFrame:
    """What a classifier of early growth sees of each cascade: size, rounds, mean and largest growth, last growth."""
    early = growth(activations.where(F.col("round") <= last_round))
    return early.groupBy("cascade").agg(F.max("size").alias("size"), F.max("round").alias("rounds"), F.avg("new").alias("mean_new"), F.max("new").alias("max_new"), F.max_by("new", "round").alias("last_new"))


def fit_logistic(rows: DataFrame, columns: list[str], label: str = "harmful") -> Column:
    """The probability of ``label``, over ``columns``, by L2 logistic regression on standardised features; the penalty is that of C = 1, that is 1 / rows.

    It is a column, not the fitted model: that one holds its training summary and with it the session, which can't be sent to tasks once the session has observed a query.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = rows.withColumn("label", F.col(label).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(regParam=1.0 / max(data.count(), 1))]).fit(data).stages[-1]
    margin = F.lit(float(model.intercept))
    for c, weight in zip(columns, model.coefficients.toArray().tolist(), strict=True):
        margin = margin + weight * F.col(c)
    return 1 / (1 + F.exp(-margin))


def throttle_by_weight(rows: DataFrame, fraction: float, *, weight: str = "weight", mass: str = "mass") -> DataFrame:
    """Of each cascade's nodes at risk, heaviest first (ties by node), the fewest that hold ``fraction`` of the mass: those before which less than that has been passed."""
    order = W.partitionBy("cascade").orderBy(F.col(weight).desc(), "node")
    before = F.coalesce(F.sum(mass).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_b", before).withColumn("_t", F.sum(mass).over(W.partitionBy("cascade"))).where(F.col("_b") < fraction * F.col("_t")).select("cascade", "node")


def exposure_mass(arcs: DataFrame, frontier: DataFrame, kappa: float = 1.0) -> DataFrame:
    """Nodes next to ``frontier(cascade, node)``: cascade, node, mass (sum of p, 1 at most), weight (1 + kappa times their own out mass)."""
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("p").alias("out_mass"))
    frontier = few(checkpoint(frontier.select("cascade", "node")))
    near = frontier.withColumnRenamed("node", "src").join(arcs, "src").select("cascade", F.col("dst").alias("node"), "p").join(frontier, ["cascade", "node"], "left_anti")
    mass = near.groupBy("cascade", "node").agg(F.least(F.lit(1.0), F.sum("p")).alias("mass"))
    return mass.join(out, "node", "left").select("cascade", "node", "mass", (1 + kappa * F.coalesce("out_mass", F.lit(0.0))).alias("weight"))


def e_benjamini_hochberg(evalues: DataFrame, alpha: float, *, m_total: int | None = None, weight: str | None = None) -> DataFrame:
    """Rejected cascades of ``evalues(cascade, e[, weight])``: the k largest weighted values, k the largest with the k-th value at least m / (k alpha). m is the number of candidates unless ``m_total`` says otherwise; weights are normalised to mean 1.

    A column ``log_e`` beside ``e``, if there is one, orders the values without weights: it tells apart those too large for a double.
    """
    w = F.lit(1.0)
    if weight is not None:
        w = F.col(weight) / F.lit(evalues.agg(F.avg(weight)).first()[0] or 1.0)
    by = F.col("log_e") if weight is None and "log_e" in evalues.columns else F.col("e") * w
    rows = evalues.select("cascade", (F.col("e") * w).alias("we"), by.alias("_by"))
    rows = checkpoint(numbered(rows, F.col("_by").desc(), F.col("cascade")).withColumn("k", F.col("number") + 1))
    m = rows.count() if m_total is None else m_total
    most = rows.where(F.col("we") >= m / (F.col("k") * alpha)).agg(F.max("k")).first()[0] or 0
    return rows.where(F.col("k") <= most).select("cascade", "we", "k")


def gated(rows: DataFrame, statistic: DataFrame, column: str, alpha: float) -> DataFrame:
    """The rows of cascades whose latest ``statistic(cascade, round, column)`` is at log(1 / alpha) or above; all rows if ``alpha`` is 1 or more."""
    if alpha >= 1:
        return rows
    now = statistic.groupBy("cascade").agg(F.max_by(column, "round").alias("_now")).where(F.col("_now") >= math.log(1 / alpha))
    return rows.join(now.select("cascade"), "cascade", "left_semi")


def throttle_uniform(rows: DataFrame, rho: float) -> DataFrame:
    """All nodes at risk, slowed down alike: cascade, node, rho."""
    return rows.select("cascade", "node", F.lit(rho).alias("rho"))


def throttle_at_random(rows: DataFrame, fraction: float, *, seed: int = 7, mass: str = "mass") -> DataFrame:
    """As ``throttle_by_weight``, in an order drawn by hash."""
    return throttle_by_weight(rows.withColumn("_drawn", uniform(seed, F.lit("throttle"), "cascade", "node")), fraction, weight="_drawn", mass=mass)


def frontier_harm(arcs: DataFrame, frontier: DataFrame, active: DataFrame, kappa: DataFrame) -> DataFrame:
    """Expected activations of the next round under ``kappa(cascade, kappa_hat)``: cascade, harm. Arcs into active nodes don't count."""
    near = few(frontier).withColumnRenamed("node", "src").join(arcs, "src").withColumnRenamed("dst", "node").join(few(active.select("cascade", "node")), ["cascade", "node"], "left_anti")
    return near.join(kappa, "cascade").groupBy("cascade").agg(F.sum(F.least(F.lit(1.0), F.col("kappa_hat") * F.col("p"))).alias("harm"))


def harm_at_alarm(arcs: DataFrame, activations: DataFrame, alarm: DataFrame, kappa: DataFrame) -> DataFrame:
    """Nodes active when the alarm fires, and their influence: 1 + kappa times the out mass, over nodes that weren't seeds."""
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("p").alias("out_mass"))
    rows = activations.join(alarm, "cascade").where(F.col("round") <= F.col("alarm_round")).join(out, "node", "left").join(kappa, "cascade")
    heavy = F.sum(F.when(F.col("round") > 0, 1 + F.col("kappa") * F.coalesce("out_mass", F.lit(0.0))).otherwise(0.0))
    return rows.groupBy("cascade").agg(F.count("*").alias("harm"), heavy.alias("weighted_harm"))


def commit_exposed(arcs: DataFrame, frontier: DataFrame, plan: DataFrame, active: DataFrame, worth: float) -> DataFrame:
    """Planned nodes to block now: q (c + 1 / worth) >= 1, q the chance to be hit next and c the inactive neighbours: cascade, node, q, c."""
    near = frontier.withColumnRenamed("node", "src").join(arcs, "src").withColumnRenamed("dst", "node").join(plan.select("cascade", "node"), ["cascade", "node"], "left_semi")
    q = near.groupBy("cascade", "node").agg((-F.expm1(F.sum(F.log1p(-F.least(F.lit(CAP), F.col("p")))))).alias("q"))
    beyond = q.withColumnRenamed("node", "src").join(arcs, "src").withColumnRenamed("dst", "node").join(active.select("cascade", "node"), ["cascade", "node"], "left_anti")
    c = beyond.groupBy("cascade", F.col("src").alias("node")).agg(F.count("*").alias("c"))
    return q.join(c, ["cascade", "node"], "left").na.fill(0, ["c"]).where(F.col("q") * (F.col("c") + 1 / worth) >= 1 - 1e-9).select("cascade", "node", "q", "c")
