"""Control of many cascades at once: batch against plain Python, stream against batch."""

import math
import random

import pytest

from diffspark.streaming.control import RULES, StreamControl, control, control_summary

SCHEMA = "cascade long, round int, log_e double, weight double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def evidence(rng, cascades=12, rounds=5):
    out, log_e = [], dict.fromkeys(range(cascades), 0.0)
    for t in range(1, rounds + 1):
        for c in range(cascades):
            if t == 1 or rng.random() < 0.8:
                log_e[c] += rng.gauss(0.9 if c % 3 == 0 else -0.4, 0.8)
                out.append((c, t, log_e[c], rng.choice([0.5, 1.0, 3.0])))
    return out


def brute(data, rule, alpha, budget):
    now, treated = {}, {}
    for t in sorted({r[1] for r in data}):
        fresh = {c: (e, w) for c, r, e, w in data if r == t}
        now = {c: (e, 0.0) for c, (e, _) in now.items()} | fresh
        pool = sorted(c for c in now if c not in treated)
        mean = sum(now[c][1] + 1e-9 for c in pool) / max(len(pool), 1)
        score = {c: math.exp(now[c][0]) * ((now[c][1] + 1e-9) / mean if rule == "weighted_ebh" else 1.0) for c in pool}
        order = sorted(pool, key=lambda c: (-score[c], c))
        if rule == "per_cascade":
            hit = [c for c in pool if now[c][0] >= -math.log(alpha)]
        else:
            hit = order[: max((k for k in range(1, len(order) + 1) if score[order[k - 1]] >= len(pool) / (k * alpha)), default=0)]
        if budget is not None:
            hit = sorted(hit, key=lambda c: (-now[c][0], c))[: max(budget - len(treated), 0)]
        treated |= dict.fromkeys(hit, t)
    return sorted(treated.items())


@pytest.mark.parametrize(("rule", "budget"), [(r, None) for r in RULES] + [("weighted_ebh", 2)])
def test_control_against_plain_python(spark, rule, budget):
    data = evidence(random.Random(5))
    got = rows(control(spark.createDataFrame(data, SCHEMA), rule, alpha=0.2, budget=budget), "cascade", "round")
    assert got == brute(data, rule, 0.2, budget) and got


@pytest.mark.parametrize(("rule", "budget"), [("weighted_ebh", None), ("per_cascade", 2)])
def test_control_by_rounds_against_plain_python(spark, rule, budget):
    data = evidence(random.Random(7), rounds=3)
    got = rows(control(spark.createDataFrame(data, SCHEMA), rule, alpha=0.2, budget=budget, most_rows=0), "cascade", "round")
    assert got == brute(data, rule, 0.2, budget) and got


def test_control_of_few_rows_needs_no_job_for_each_round(spark):
    """60 rounds, as long cascades have: the jobs don't grow with them."""
    data = [(c, t, 0.01 * c * t - 1, 1.0) for c in range(3) for t in range(1, 61)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("control-of-few", "")
    got = rows(control(spark.createDataFrame(data, SCHEMA), "ebh", alpha=0.2), "cascade", "round")
    jobs = len(tracker.getJobIdsForGroup("control-of-few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute(data, "ebh", 0.2, None) and jobs < 20


def test_control_without_evidence(spark):
    assert control(spark.createDataFrame([], SCHEMA), "ebh").isEmpty()
    with pytest.raises(ValueError):
        control(spark.createDataFrame([(1, 1, 0.0, 1.0)], SCHEMA), "other")


def test_stream_control_equals_batch(spark, tmp_path):
    data = evidence(random.Random(5))
    late = [(0, 1, 50.0, 1.0)]
    for part in ([r for r in data if r[1] <= 2], [r for r in data if r[1] == 3], [r for r in data if r[1] > 3] + late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    sink = StreamControl(str(tmp_path / "state"), "weighted_ebh", alpha=0.2, budget=3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    want = brute(data, "weighted_ebh", 0.2, 3)
    assert rows(sink.treated(spark, 2), "cascade", "round") == want
    # A batch that is repeated after a failure counts once.
    sink(spark.createDataFrame([r for r in data if r[1] == 3], SCHEMA), 1)
    assert rows(sink.treated(spark, 1), "cascade", "round") == [x for x in want if x[1] <= 3]


def test_summary(spark):
    truth = spark.createDataFrame([(0, True), (1, True), (2, False), (3, False)], "cascade long, harmful boolean")
    act = spark.createDataFrame([(c, n, r) for c in range(4) for n, r in enumerate([0, 1, 1, 2, 3])], "cascade long, node long, round int")
    treated = spark.createDataFrame([(0, 1), (2, 2)], "cascade long, round int")
    assert control_summary(treated, truth, act).first().asDict() == {"treated": 2, "false_discoveries": 1, "fdp": 0.5, "power": 0.5, "avoidable_frac": 0.2}
    none = control_summary(treated.limit(0), truth, act).first()
    assert (none["treated"], none["fdp"], none["power"]) == (0, 0.0, 0.0)
