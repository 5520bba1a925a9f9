"""Accuracy and calibration of ``scores(sim_id, node, score)`` against ``truth(sim_id, source)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.rng import uniform
from diffspark.operators.graph import reach


def instance_metrics(scores: DataFrame, truth: DataFrame, *, ks: tuple[int, ...] = (1, 3, 5), level: float = 0.9) -> DataFrame:
    """One row for each outbreak: hits, rr, css, brier.

    top<k>: the expected hit when ties are broken at random, clip((k - greater) / tied, 0, 1). rr: 1 / (greater + (tied + 1) / 2). css: how many nodes, likeliest first, make up ``level`` of the softmax. brier: squared error of the softmax. A source without a score has no hit and rr 0.
    """
    per = W.partitionBy("sim_id")
    p = F.exp(F.col("score") - F.max("score").over(per))
    soft = scores.withColumn("_e", p).withColumn("prob", F.col("_e") / F.sum("_e").over(per))
    before = F.coalesce(F.sum("prob").over(per.orderBy(F.col("prob").desc(), "node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = soft.withColumn("_before", before).join(truth, "sim_id").withColumn("own", F.col("node") == F.col("source"))
    mine = F.max(F.when(F.col("own"), F.col("score"))).over(per)
    rows = rows.withColumn("_mine", mine)
    out = rows.groupBy("sim_id").agg(
        F.count_if(F.col("score") > F.col("_mine")).alias("greater"), F.count_if(F.col("score") == F.col("_mine")).alias("tied"),
        F.count_if(F.col("_before") < level - 1e-12).alias("css"), F.sum((F.col("prob") - F.col("own").cast("int")) ** 2).alias("brier"), F.count_if("own").alias("_found"),
    )
    brier = F.col("brier") + F.when(F.col("_found") > 0, 0.0).otherwise(1.0)
    hits = [F.when(F.col("tied") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k - F.col("greater")) / F.col("tied")))).otherwise(0.0).alias(f"top{k}") for k in ks]
    rr = F.when(F.col("tied") > 0, 1 / (F.col("greater") + (F.col("tied") + 1) / 2)).otherwise(0.0)
    return out.select("sim_id", *hits, rr.alias("rr"), "css", brier.alias("brier"))


def estimates(scores: DataFrame, *, seed: int = 7) -> DataFrame:
    """The best node of each outbreak, ties by hash: sim_id, node."""
    order = W.partitionBy("sim_id").orderBy(F.col("score").desc(), uniform(seed, F.lit("map"), "sim_id", "node"), "node")
    return scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("sim_id", "node")


def error_distance(edges: DataFrame, estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """Hops between each outbreak's true source and ``estimates(sim_id, node)``: sim_id, error_distance (-1 where there is no path). All outbreaks are searched together."""
    hops = reach(edges, truth.select("sim_id", F.col("source").alias("node")), keys=["sim_id"])
    return estimates.join(hops, ["sim_id", "node"], "left").select("sim_id", F.coalesce("dist", F.lit(-1)).alias("error_distance"))


def saved_fraction(live: DataFrame, seeds: DataFrame, samples: int, ranking: DataFrame, budgets: list[int], n: int) -> DataFrame:
    """What blocking the first nodes of ``ranking(node, rank)`` saves, for each budget: budget, base, after (mean reach without and with it), saved_frac, bad_frac (of all ``n`` nodes). All budgets advance together."""
    cases = live.sparkSession.createDataFrame([(b,) for b in sorted({0, *budgets})], "budget int")
    starts = seeds.select("node").crossJoin(cases).select("budget", "node", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    gone = ranking.join(cases, F.col("rank") <= F.col("budget")).select("budget", F.col("node").alias("dst"))
    arcs = live.crossJoin(F.broadcast(cases)).join(gone, ["budget", "dst"], "left_anti")
    counts = reach(arcs, starts, keys=["budget", "sample"]).groupBy("budget").agg((F.count("*") / samples).alias("after"))
    base = counts.where("budget = 0").select(F.col("after").alias("base"))
    return counts.where("budget > 0").crossJoin(base).select("budget", "base", "after", (1 - F.col("after") / F.col("base")).alias("saved_frac"), (F.col("after") / n).alias("bad_frac"))


def typical(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, 90th percentile (interpolated) and number of values, by group."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.count(value).alias("n"))


def line_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Sample covariance of two columns and the slope of the least-squares line of ``y`` over ``x``, by group."""
    return rows.groupBy(*by).agg(F.covar_samp(y, x).alias("cov"), F.regr_slope(y, x).alias("slope"))


def summary(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and standard error of each column, by group: n, <c>, <c>_se; the error of a single row is 0."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(c), F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0)).alias(f"{c}_se")]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *out)


def paired_difference(rows: DataFrame, method: str, other: str, value: str, on: list[str]) -> DataFrame:
    """Mean paired difference of two methods, its standard error, z, and how often the first has less, ties as a half."""
    a = rows.where(F.col("method") == method).select(*on, F.col(value).alias("a"))
    b = rows.where(F.col("method") == other).select(*on, F.col(value).alias("b"))
    d = a.join(b, on).withColumn("d", F.col("a") - F.col("b"))
    win = F.when(F.col("d") < 0, 1.0).when(F.col("d") == 0, 0.5).otherwise(0.0)
    out = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"), F.avg(win).alias("win_rate"))
    z = F.when(F.col("se") > 0, F.col("mean") / F.col("se"))
    return out.withColumn("z", z).withColumn("verdict", F.when(z < -2, "less").when(z > 2, "more").otherwise("no difference"))


def detection_summary(episodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of ``episodes(harmful, alarm_round, harm_at_alarm, harm_final, harm_counterfactual)``: false alarms and their error, detection, delay, harm at alarm, saved share, benign loss."""
    harmful, benign, alarm = F.col("harmful"), ~F.col("harmful"), F.col("alarm_round").isNotNull()
    fa = F.avg(F.when(benign, alarm.cast("double")))
    loss = F.sum(F.when(benign, F.col("harm_counterfactual") - F.col("harm_final")))
    return episodes.groupBy(*(by or [])).agg(
        fa.alias("false_alarms"), F.sqrt(fa * (1 - fa) / F.count_if(benign)).alias("false_alarms_se"), F.avg(F.when(harmful, alarm.cast("double"))).alias("detected"),
        F.avg(F.when(harmful, F.col("alarm_round"))).alias("delay"), F.avg(F.when(harmful, F.col("harm_at_alarm"))).alias("harm_at_alarm"),
        (1 - F.sum(F.when(harmful, F.col("harm_final"))) / F.sum(F.when(harmful, F.col("harm_counterfactual")))).alias("saved"), (loss / F.count_if(benign)).alias("benign_loss"),
    )


def detection_report(episodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All of ``detection_summary``, over ``episodes`` with also weighted_harm_at_alarm, kappa and kappa_hat (null without an alarm): and the mean weighted harm at alarm, the share of benign harm that is lost, the mean error of kappa_hat over detected harmful cascades, and the mean final and free harm of harmful ones."""
    harmful, benign = F.col("harmful"), ~F.col("harmful")
    mean = lambda c: F.avg(F.when(harmful, c))
    loss, free = F.sum(F.when(benign, F.col("harm_counterfactual") - F.col("harm_final"))), F.sum(F.when(benign, F.col("harm_counterfactual")))
    more = episodes.groupBy(*(by or [])).agg(
        F.count_if(benign).alias("n_benign"), F.count_if(harmful).alias("n_harmful"), mean(F.when(F.col("alarm_round").isNotNull(), F.col("weighted_harm_at_alarm"))).alias("weighted_harm_at_alarm"),
        F.when(free > 0, loss / free).alias("benign_loss_frac"), mean(F.abs(F.col("kappa_hat") - F.col("kappa"))).alias("kappa_mae"), mean(F.col("harm_final")).alias("harm_final"), mean(F.col("harm_counterfactual")).alias("harm_counterfactual"),
    )
    base = detection_summary(episodes, by)
    return base.join(more, by) if by else base.crossJoin(more)  # one row each


def policy_verdict(spreads: DataFrame, a: str, b: str, on: list[str], *, none: str = "none") -> DataFrame:
    """Policy ``a`` against ``b`` on the same worlds of ``spreads(*on, policy, spread)``: one row with n, each one's saved share against ``none``, gain (mean spread of b less a), its standard error, gain in per cent of the free spread, z, and the verdict: the winner beyond two standard errors, or tie."""
    wide = pivoted(spreads, on, "policy", [none, a, b], "spread", F.first).na.fill(0)
    d = F.col(b) - F.col(a)
    out = wide.agg(F.count("*").alias("n"), *((1 - F.sum(x) / F.sum(none)).alias(f"{x}_saved") for x in (a, b)), F.avg(d).alias("gain"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), (100 * F.sum(d) / F.sum(none)).alias("pct"))
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("gain") / F.col("se")))
    return out.withColumn("verdict", F.when(F.col("z") > 2, f"{a} wins").when(F.col("z") < -2, f"{b} wins").otherwise("tie"))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The latest row of each key."""
    order = W.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pivoted(rows: DataFrame, index: list[str], column: str, names: list, value: str, how=F.avg) -> DataFrame:
    return rows.groupBy(*index).pivot(column, names).agg(how(value))
