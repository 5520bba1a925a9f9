"""One decision over all running cascades, round by round: in batch, or in each micro-batch of a stream."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.operators.graph import SENT
from diffspark.operators.sequential import e_benjamini_hochberg

RULES = ("per_cascade", "ebh", "weighted_ebh")
#: The running state: the latest evidence of each cascade, the round of it, and the round in which it was treated, if it was.
STATE = "cascade long, log_e double, weight double, round int, treated int"


def decide(now: DataFrame, rule: str, alpha: float) -> DataFrame:
    """Of the untreated cascades ``now(cascade, log_e, weight)`` those to treat: cascade.

    ``per_cascade``: each whose e-value reaches 1 / alpha, which bounds the chance of a false alarm of each. ``ebh``: those that Benjamini and Hochberg's rule on e-values rejects, which bounds the expected share of false alarms among all alarms. ``weighted_ebh``: the same on e-values times weights of mean 1.
    """
    if rule == "per_cascade":
        return now.where(F.col("log_e") >= -math.log(alpha)).select("cascade")
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    rows = now.select("cascade", F.exp(F.least("log_e", F.lit(700.0))).alias("e"), (F.col("weight") + 1e-9).alias("weight"))
    return e_benjamini_hochberg(rows, alpha, weight="weight" if rule == "weighted_ebh" else None).select("cascade")


def advanced(state: DataFrame, news: DataFrame, turn: int, rule: str, alpha: float, budget: int | None) -> DataFrame:
    """The state after the evidence ``news(cascade, round, log_e, weight)`` of round ``turn`` and one decision. Treated cascades stay treated and are no candidates; cascades without news keep their evidence and weigh nothing more than a rest. ``budget``: treatments that may still be given in all; the largest evidence comes first."""
    new = news.select("cascade", F.col("log_e").alias("_e"), F.col("weight").alias("_w"), F.lit(True).alias("_new"))
    rows = state.join(new, "cascade", "full")
    rows = rows.select("cascade", F.coalesce("_e", "log_e").alias("log_e"), F.coalesce("_w", F.lit(0.0)).alias("weight"), F.when(F.col("_new"), F.lit(turn)).otherwise(F.col("round")).alias("round"), "treated")
    rows = checkpoint(rows)
    chosen = decide(rows.where("treated is null"), rule, alpha)
    if budget is not None:
        left = budget - rows.where("treated is not null").count()
        chosen = chosen.join(rows, "cascade").orderBy(F.col("log_e").desc(), "cascade").limit(max(left, 0)).select("cascade")
    picked = chosen.withColumn("_hit", F.lit(True))
    return checkpoint(rows.join(picked, "cascade", "left").select("cascade", "log_e", "weight", "round", F.coalesce("treated", F.when(F.col("_hit"), F.lit(turn))).cast("int").alias("treated")))


def _in_one_task(rule: str, alpha: float, budget: int | None):
    """``control`` of evidence that one task holds, round by round in arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf["cascade"].to_numpy(), return_inverse=True)
        log_e, treated = np.full(len(names), np.nan), np.zeros(len(names), "i8")
        when, values, weights = (pdf[c].to_numpy() for c in ("round", "log_e", "weight"))
        for turn in np.unique(when):
            new = when == turn
            weight = np.zeros(len(names))
            log_e[at[new]], weight[at[new]] = values[new], weights[new]
            pool = np.flatnonzero(~np.isnan(log_e) & (treated == 0))
            if rule == "per_cascade":
                hit = pool[log_e[pool] >= -math.log(alpha)]
            else:
                e = np.exp(np.minimum(log_e[pool], 700.0))
                if rule == "weighted_ebh" and len(pool):
                    e = e * ((weight[pool] + 1e-9) / np.mean(weight[pool] + 1e-9))
                order = np.lexsort((pool, -e))
                passed = np.flatnonzero(e[order] >= len(pool) / (np.arange(1, len(pool) + 1) * alpha))
                hit = pool[order[: passed[-1] + 1]] if len(passed) else pool[:0]
            if budget is not None:
                hit = hit[np.lexsort((hit, -log_e[hit]))][: max(budget - int((treated > 0).sum()), 0)]
            treated[hit] = turn
        done = treated > 0
        return pd.DataFrame({"cascade": names[done], "round": treated[done]})

    return run


def control(evidence: DataFrame, rule: str, *, alpha: float = 0.1, budget: int | None = None, most_rows: int = SENT) -> DataFrame:
    """The treated cascades of ``evidence(cascade, round, log_e, weight)`` and their rounds, by one decision over all cascades a round: cascade, round.

    Rounds follow one another. Evidence of up to ``most_rows`` rows is gone through by one task; of more, each round is a few jobs over all cascades (``advanced``).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    evidence, n = counted(evidence.select("cascade", "round", "log_e", "weight"))
    if n <= most_rows:
        return evidence.groupBy().applyInPandas(_in_one_task(rule, alpha, budget), "cascade long, round int")
    state = evidence.sparkSession.createDataFrame([], STATE)
    for turn in sorted(r["round"] for r in evidence.select("round").distinct().collect()):
        state = advanced(state, evidence.where(F.col("round") == turn), turn, rule, alpha, budget)
    return state.where("treated is not null").select("cascade", F.col("treated").alias("round"))


class StreamControl:
    """``control`` over a stream, for ``writeStream.foreachBatch``: all evidence of a round must come in one micro-batch, which may hold several.

    The state is a table for each batch in ``folder``, which all executors share, written over if a batch is repeated after a failure, so a batch counts once. Evidence of a round that is decided comes too late and is left out.
    """

    def __init__(self, folder: str, rule: str, *, alpha: float = 0.1, budget: int | None = None):
        self.folder, self.rule, self.alpha, self.budget = folder, rule, alpha, budget

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The state after a batch, an empty one before the first."""
        if batch_id < 0:
            return spark.createDataFrame([], STATE)
        try:
            return spark.read.schema(STATE).parquet(f"{self.folder}/batch={batch_id}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], STATE)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = self.state(spark, batch_id - 1)
        last = state.agg(F.max("round")).first()[0]
        news = checkpoint(batch.select("cascade", "round", "log_e", "weight").where(F.lit(True) if last is None else F.col("round") > last))
        for turn in sorted(r["round"] for r in news.select("round").distinct().collect()):
            state = advanced(state, news.where(F.col("round") == turn), turn, self.rule, self.alpha, self.budget)
        state.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def treated(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """cascade, round of the treatments up to a batch."""
        return self.state(spark, batch_id).where("treated is not null").select("cascade", F.col("treated").alias("round"))


def control_summary(treated: DataFrame, truth: DataFrame, activations: DataFrame) -> DataFrame:
    """One row over ``truth(cascade, harmful)``: treated, false_discoveries, fdp (their share of the treated), power (share of the harmful that is treated), avoidable_frac (share of the harmful cascades' activations that come after the round of treatment: what stopping there would save)."""
    rows = truth.join(treated.select("cascade", F.col("round").alias("at")), "cascade", "left")
    sizes = activations.join(rows.where("harmful"), "cascade").groupBy("cascade").agg(F.count("*").alias("size"), F.count(F.when(F.col("round") > F.col("at"), 1)).alias("after"))
    rows = rows.join(sizes, "cascade", "left").withColumn("on", F.col("at").isNotNull())
    count = lambda c: F.count(F.when(c, 1))
    harmful, hit = F.col("harmful"), F.col("on")
    return rows.agg(
        count(hit).alias("treated"), count(hit & ~harmful).alias("false_discoveries"), (count(hit & ~harmful) / F.greatest(count(hit), F.lit(1))).alias("fdp"),
        (count(hit & harmful) / F.greatest(count(harmful), F.lit(1))).alias("power"), (F.coalesce(F.sum("after"), F.lit(0)) / F.greatest(F.coalesce(F.sum("size"), F.lit(0)), F.lit(1))).alias("avoidable_frac"),
    )
