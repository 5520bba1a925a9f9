"""Registered queries of the lazy, racing and adaptive planners, of control over many cascades, and of exact evaluation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, kept
from diffspark.operators import adaptive, blocking, diffusion, exact, graph, intervals, lazy, metrics, sequential
from diffspark.plans.queries import _EPROC, _SEQ, CASCADES, EDGES, GRID, SEED, START, THETA, WC, _first_pick_sql, edges_of, evidence_of, hops_sql, hub, live_sql, picks_sql, running_cascades, spread_of, worlds_of
from diffspark.plans.registry import query
from diffspark.streaming.control import RULES, control, control_summary


@query("celf_plan", picks_sql(THETA, 4) + " " + " UNION ALL ".join(f"SELECT {i} AS rank, node, gain FROM p{i} WHERE gain > 0" for i in range(1, 5)))
def celf_plan(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir)
    return lazy.celf_greedy(live, start, 4).select("rank", "node", "gain")


RACE = (16, 32, 48, 64)


def race_sql(stages: tuple[int, ...], z: float) -> str:
    parts, pool = [_first_pick_sql(stages[-1]).rstrip()], "(SELECT DISTINCT cut AS node FROM gains)"
    for i, n in enumerate(stages):
        parts.append(f"""t{i} AS MATERIALIZED (SELECT g.cut AS node, sum(g.gain) AS s, sum(g.gain * g.gain) AS q FROM gains g JOIN {pool} c ON c.node = g.cut WHERE g.sample < {n} GROUP BY g.cut),
lead{i} AS MATERIALIZED (SELECT * FROM t{i} ORDER BY s DESC, node LIMIT 1),
both{i} AS (SELECT g.cut AS node, sum(g.gain * h.gain) AS c FROM gains g JOIN gains h ON h.sample = g.sample JOIN lead{i} l ON h.cut = l.node WHERE g.sample < {n} GROUP BY g.cut),
near{i} AS MATERIALIZED (SELECT t.node FROM t{i} t CROSS JOIN lead{i} l LEFT JOIN both{i} b ON b.node = t.node WHERE t.node <> l.node
  AND NOT (l.s - t.s) / {n}.0::DOUBLE > {z}::DOUBLE * sqrt(greatest(0.0::DOUBLE, l.q - 2 * coalesce(b.c, 0) + t.q - (l.s - t.s) * (l.s - t.s) / {n}.0::DOUBLE) / {n - 1}.0::DOUBLE / {n}.0::DOUBLE)),
next{i} AS MATERIALIZED (SELECT node FROM near{i} UNION ALL SELECT node FROM lead{i})""")
        pool = f"next{i}"
    # The first stage after which the leader is alone; the last one, if there is none.
    ends = " UNION ALL ".join(f"SELECT {i} AS i, {n} AS worlds, l.node, l.s AS gain, (SELECT count(*) FROM near{i}) AS rest FROM lead{i} l" for i, n in enumerate(stages))
    return ",\n".join(parts) + f", ends AS ({ends}) SELECT 1 AS rank, node, CAST(gain AS BIGINT) AS gain, worlds, CAST(rest AS BIGINT) AS left FROM ends WHERE rest = 0 OR i = {len(stages) - 1} ORDER BY i LIMIT 1"


@query("racing_pick", race_sql(RACE, 2.5))
def racing_pick(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    arcs, start = kept(diffusion.edge_probabilities(edges, "wc")), checkpoint(hub(edges))
    return lazy.racing_greedy(arcs, start, 1, first=RACE[0], batch=RACE[1] - RACE[0], most=RACE[-1], seed=SEED)


ALPHA = 0.2
#: Evidence and harm of each cascade and round; what is known by each round; and one decision after another.
_CONTROL = f"""{_SEQ}, {_EPROC},
weights AS (SELECT e.cascade, e.round, e.log_e, coalesce((SELECT sum(least(1.0::DOUBLE, e.kappa_hat * r.p)) FROM act a JOIN arcs r ON r.src = a.node
  WHERE a.cascade = e.cascade AND a.round = e.round AND NOT EXISTS (SELECT 1 FROM act b WHERE b.cascade = e.cascade AND b.node = r.dst AND b.round <= e.round)), 0) AS harm FROM ep e),
turns AS (SELECT DISTINCT round AS turn FROM weights),
known AS MATERIALIZED (SELECT t.turn, w.cascade, arg_max(w.log_e, w.round) AS log_e, CASE WHEN max(w.round) = t.turn THEN arg_max(w.harm, w.round) ELSE 0 END AS harm
  FROM turns t JOIN weights w ON w.round <= t.turn GROUP BY t.turn, w.cascade),
ctl AS (SELECT unnest(['ebh', 'weighted_ebh']) AS rule, 0 AS turn, cascade, NULL::INTEGER AS treated FROM cascades
  UNION ALL SELECT rule, turn, cascade, CASE WHEN treated IS NULL AND cand AND k <= coalesce(most, 0) THEN turn ELSE treated END FROM (
    SELECT *, max(CASE WHEN we >= m / (k * {ALPHA}::DOUBLE) THEN k END) OVER (PARTITION BY rule, cand) AS most FROM (
      SELECT *, row_number() OVER (PARTITION BY rule, cand ORDER BY we DESC, cascade) AS k, count(*) OVER (PARTITION BY rule, cand) AS m FROM (
        SELECT *, exp(least(log_e, 700.0::DOUBLE)) * CASE WHEN rule = 'ebh' THEN 1.0::DOUBLE ELSE (harm + 1e-9::DOUBLE) / avg(harm + 1e-9::DOUBLE) OVER (PARTITION BY rule, cand) END AS we FROM (
          SELECT c.rule, c.turn + 1 AS turn, c.cascade, c.treated, n.log_e, n.harm, c.treated IS NULL AND n.log_e IS NOT NULL AS cand
          FROM ctl c LEFT JOIN known n ON n.turn = c.turn + 1 AND n.cascade = c.cascade WHERE c.turn < (SELECT max(turn) FROM turns)))))),
done AS MATERIALIZED (SELECT rule, cascade, max(treated) AS round FROM ctl GROUP BY rule, cascade HAVING max(treated) IS NOT NULL
  UNION ALL SELECT 'per_cascade', cascade, min(round) FROM ep WHERE log_e >= ln(1 / {ALPHA}::DOUBLE) GROUP BY cascade)"""


def controlled(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rule, cascade, round of each treatment; the cascades; their activations"""
    arcs, cascades, act, _, evidence = evidence_of(spark, sf_dir)
    process = checkpoint(sequential.eprocess(evidence, len(GRID), GRID))
    # The arcs that lead from each round's activations to nodes that are free after it.
    front = checkpoint(act.join(process.select("cascade", "round", "kappa_hat"), ["cascade", "round"]).select("cascade", "round", "kappa_hat", F.col("node").alias("src")))
    met = graph.few(front).join(arcs, "src")
    hit = graph.few(act.select("cascade", F.col("node").alias("dst"), F.col("round").alias("_when")))
    free = met.join(hit, ["cascade", "dst"], "left").where(F.col("_when").isNull() | (F.col("_when") > F.col("round")))
    harm = free.groupBy("cascade", "round").agg(F.sum(F.least(F.lit(1.0), F.col("kappa_hat") * F.col("p"))).alias("weight"))
    rows = checkpoint(process.join(harm, ["cascade", "round"], "left").select("cascade", "round", "log_e", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    parts = [control(rows, rule, alpha=ALPHA).select(F.lit(rule).alias("rule"), "cascade", "round") for rule in RULES]
    return checkpoint(reduce(DataFrame.unionByName, parts)), cascades, act


@query("stream_control", f"{_CONTROL} SELECT rule, cascade, CAST(round AS INTEGER) AS round FROM done")
def stream_control(spark, sf_dir):
    """Which cascades each rule treats, and in which round, if one decision a round is made over all of them."""
    return controlled(spark, sf_dir)[0]


@query("stream_control_summary", f"""{_CONTROL},
truth AS (SELECT r.rule, c.cascade, c.kappa > 1 AS harmful, d.round AS at FROM (SELECT unnest(['per_cascade', 'ebh', 'weighted_ebh']) AS rule) r CROSS JOIN cascades c LEFT JOIN done d ON d.rule = r.rule AND d.cascade = c.cascade),
sizes AS (SELECT t.rule, t.cascade, count(*) AS size, count(*) FILTER (WHERE a.round > t.at) AS after FROM truth t JOIN act a ON a.cascade = t.cascade WHERE t.harmful GROUP BY t.rule, t.cascade)
SELECT t.rule, count(t.at) AS treated, count(*) FILTER (WHERE t.at IS NOT NULL AND NOT t.harmful) AS false_discoveries, count(*) FILTER (WHERE t.at IS NOT NULL AND NOT t.harmful) / greatest(count(t.at), 1) AS fdp,
  count(*) FILTER (WHERE t.at IS NOT NULL AND t.harmful) / greatest(count(*) FILTER (WHERE t.harmful), 1) AS power, coalesce(sum(s.after), 0) / greatest(coalesce(sum(s.size), 0), 1) AS avoidable_frac
FROM truth t LEFT JOIN sizes s ON s.rule = t.rule AND s.cascade = t.cascade GROUP BY t.rule""")  # fmt: skip
def stream_control_summary(spark, sf_dir):
    treated, cascades, act = controlled(spark, sf_dir)
    truth = cascades.select("cascade", (F.col("kappa") > 1).alias("harmful"))
    parts = [control_summary(treated.where(F.col("rule") == rule), truth, act).select(F.lit(rule).alias("rule"), "*") for rule in RULES]
    return reduce(DataFrame.unionByName, parts)


@query("contain_adaptive")
def contain_adaptive(spark, sf_dir):
    """Each cascade's size with and without containment that plans anew each round from its alarm on, and the nodes that it blocks."""
    arcs, cascades, act, _, evidence = evidence_of(spark, sf_dir)
    process = checkpoint(sequential.eprocess(evidence, len(GRID), GRID))
    alarm = checkpoint(sequential.alarms(process, "log_e", math.log(5)))
    kappa = checkpoint(process.join(alarm, "cascade").where(F.col("round") == F.col("alarm_round")).select("cascade", F.col("kappa_hat").alias("kappa")))
    # Evidence of a round may come after the last activation: such a cascade has nothing left to contain.
    alarm = checkpoint(alarm.join(act.select("cascade", F.col("round").alias("alarm_round")).distinct(), ["cascade", "alarm_round"], "left_semi"))
    out = adaptive.adaptive_containment(arcs, cascades.select("cascade", "kappa"), act, alarm, kappa, 4, samples=8, held_out=8, seed=SEED)
    size = lambda df, name: df.groupBy("cascade").agg(F.count("*").alias(name))
    return size(act, "harm_counterfactual").join(size(out.activations, "harm"), "cascade", "left").join(size(out.blocked, "n_blocked"), "cascade", "left").join(alarm, "cascade", "left").na.fill(0, ["harm", "n_blocked"])


# An order and its lines as a ring: from the order to its first line, from line to line, and from the last line back.
_RING = """lines AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_quantity / 100.0::DOUBLE AS p FROM lineitem),
ways AS MATERIALIZED (SELECT g, i, exp(sum(ln(p)) OVER (PARTITION BY g ORDER BY i)) AS a,
  exp(coalesce(sum(ln(p)) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) * last_value(p) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM lines)"""


def rings(spark, sf_dir) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("graph_id"), (F.col("l_quantity") / 100.0).alias("p"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long").alias("i"))
    packed = lines.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct((F.col("i") - 1).alias("u"), F.col("i").alias("v"), "p"))).alias("edges"))
    back = F.element_at("edges", -1)
    closed = F.array_append("edges", F.struct(back["v"].alias("u"), F.lit(0).cast("long").alias("v"), back["p"].alias("p")))
    return packed.select("graph_id", closed.alias("edges"), F.array(F.lit(0).cast("long")).alias("seeds"), F.array().cast("array<bigint>").alias("blocked"))


@query("exact_spread_rings", f"WITH {_RING} SELECT g AS graph_id, round(sum(a + b - a * b), 9) AS spread FROM ways GROUP BY g")
def exact_spread_rings(spark, sf_dir):
    """Exact spread from each order round the ring of its lines, by the frontier's states."""
    return exact.frontier_spread(rings(spark, sf_dir)).withColumn("spread", F.round("spread", 9))


@query("blocking_sets_rings", f"""WITH {_RING},
sums AS MATERIALIZED (SELECT g, i, coalesce(sum(a) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, coalesce(sum(b) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS behind, count(*) OVER (PARTITION BY g) AS n FROM ways),
pairs AS MATERIALIZED (SELECT x.g, x.i AS lo, y.i AS hi, round(x.ahead + y.behind, 12) AS spread FROM sums x JOIN sums y ON y.g = x.g AND (x.i < y.i OR x.n = 1 AND x.i = y.i)),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY spread, lo, hi) AS r FROM pairs),
one AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY round(ahead + behind, 12), i) AS r FROM sums),
two AS (SELECT p.*, row_number() OVER (PARTITION BY p.g ORDER BY p.spread, CASE WHEN p.lo = o.i THEN p.hi ELSE p.lo END) AS r FROM pairs p JOIN one o ON o.g = p.g AND o.r = 1 AND (p.lo = o.i OR p.hi = o.i))
SELECT b.g AS graph_id, CASE WHEN b.lo = b.hi THEN b.lo::VARCHAR ELSE b.lo || ',' || b.hi END AS optimal, round(b.spread, 9) AS optimal_spread, CASE WHEN t.lo = t.hi THEN t.lo::VARCHAR ELSE t.lo || ',' || t.hi END AS greedy, round(t.spread, 9) AS greedy_spread
FROM best b JOIN two t ON t.g = b.g AND t.r = 1 WHERE b.r = 1""")  # fmt: skip
def blocking_sets_rings(spark, sf_dir):
    """The two lines of each order whose blocking leaves least of its exact spread, and the two that exact greedy takes."""
    graphs = checkpoint(rings(spark, sf_dir))
    told = lambda df, name: df.select("graph_id", F.array_join(F.col("blocked").cast("array<string>"), ",").alias(name), F.round("spread", 9).alias(f"{name}_spread"))
    greedy = exact.greedy_sets(graphs, 2)
    return told(exact.optimal_sets(graphs, 2, bound=greedy), "optimal").join(told(greedy, "greedy"), "graph_id")


@query("bfs_ball", f"WITH RECURSIVE {EDGES}, {START}, {hops_sql('walk', 'start')} SELECT node, dist FROM walk ORDER BY dist, node LIMIT 300")
def bfs_ball(spark, sf_dir):
    """The 300 nodes nearest to the hub."""
    edges = edges_of(spark, sf_dir)
    return graph.ball(edges, hub(edges), 300)


@query("open_orders", """WITH spans AS (SELECT o_orderkey, any_value(o_orderdate) AS a, max(l_shipdate) AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
events AS (SELECT a AS t, FALSE AS after, 1 AS d FROM spans WHERE a <= z UNION ALL SELECT z, TRUE, -1 FROM spans WHERE a <= z),
sums AS (SELECT t, after, sum(d) AS d FROM events GROUP BY t, after)
SELECT CAST(epoch(t) AS BIGINT) AS second, after, CAST(sum(d) OVER (ORDER BY t, after) AS BIGINT) AS open FROM sums""")  # fmt: skip
def open_orders(spark, sf_dir):
    """How many orders are open, from their dates to their last shipments, at each time."""
    last = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate").join(last, "o_orderkey")
    return intervals.open_counts(spans, "o_orderdate", "shipped").select(F.unix_timestamp("time").alias("second"), "after", "open")


@query("detection_report", f"""{_SEQ}, {_EPROC}, alarm AS (SELECT cascade, min(round) AS alarm_round FROM ep WHERE log_e >= ln(5) GROUP BY cascade),
om AS (SELECT src AS node, sum(p) AS m FROM arcs GROUP BY src), fin AS (SELECT cascade, count(*) AS h FROM act GROUP BY cascade),
hit AS (SELECT a.cascade, count(*) AS h, sum(CASE WHEN a.round > 0 THEN 1 + c.kappa * coalesce(o.m, 0) ELSE 0 END) AS w FROM act a JOIN alarm m ON m.cascade = a.cascade JOIN cascades c ON c.cascade = a.cascade LEFT JOIN om o ON o.node = a.node WHERE a.round <= m.alarm_round GROUP BY a.cascade),
eps AS (SELECT c.cascade, c.kappa > 1 AS bad, c.kappa, e.kappa_hat, m.alarm_round, t.h AS h, t.w AS w, coalesce(t.h, f.h)::DOUBLE AS hf, f.h::DOUBLE AS hc FROM cascades c JOIN fin f ON f.cascade = c.cascade LEFT JOIN alarm m ON m.cascade = c.cascade LEFT JOIN hit t ON t.cascade = c.cascade LEFT JOIN ep e ON e.cascade = c.cascade AND e.round = m.alarm_round),
r AS (SELECT avg(CASE WHEN NOT bad THEN CASE WHEN alarm_round IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END) AS fa, count(*) FILTER (WHERE NOT bad) AS nb, count(*) FILTER (WHERE bad) AS nh, avg(CASE WHEN bad THEN CASE WHEN alarm_round IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END) AS det,
  avg(alarm_round) FILTER (WHERE bad) AS delay, avg(h) FILTER (WHERE bad) AS haa, avg(w) FILTER (WHERE bad) AS hwa, 1 - sum(hf) FILTER (WHERE bad) / sum(hc) FILTER (WHERE bad) AS saved, avg(hc - hf) FILTER (WHERE NOT bad) AS bl, sum(hc - hf) FILTER (WHERE NOT bad) / sum(hc) FILTER (WHERE NOT bad) AS blf,
  avg(abs(kappa_hat - kappa)) FILTER (WHERE bad) AS mae, avg(hf) FILTER (WHERE bad) AS hf, avg(hc) FILTER (WHERE bad) AS hc FROM eps)
SELECT nb AS n_benign, nh AS n_harmful, round(fa, 6) AS false_alarms, round(sqrt(fa * (1 - fa) / nb), 6) AS false_alarms_se, round(det, 6) AS detected, round(delay, 6) AS delay, round(haa, 6) AS harm_at_alarm, round(hwa, 4) AS weighted_harm_at_alarm,
  round(saved, 6) AS saved, round(bl, 6) AS benign_loss, round(blf, 6) AS benign_loss_frac, round(mae, 4) AS kappa_mae, round(hf, 6) AS harm_final, round(hc, 6) AS harm_counterfactual FROM r""")  # fmt: skip
def detection_report(spark, sf_dir):
    """Every figure of detection if a cascade stops at its alarm."""
    arcs, cascades, act, _, ev = evidence_of(spark, sf_dir)
    process = checkpoint(sequential.eprocess(ev, len(GRID), GRID))
    alarm = checkpoint(sequential.alarms(process, "log_e", math.log(5)))
    at = sequential.harm_at_alarm(arcs, act, alarm, cascades.select("cascade", "kappa")).select("cascade", F.col("harm").alias("harm_at_alarm"), F.col("weighted_harm").alias("weighted_harm_at_alarm"))
    told = process.select("cascade", F.col("round").alias("alarm_round"), "kappa_hat").join(alarm, ["cascade", "alarm_round"])
    end = act.groupBy("cascade").agg(F.count("*").alias("harm_counterfactual"))
    eps = cascades.join(end, "cascade").join(told, "cascade", "left").join(at, "cascade", "left")
    eps = eps.select((F.col("kappa") > 1).alias("harmful"), "kappa", "kappa_hat", "alarm_round", "harm_at_alarm", "weighted_harm_at_alarm", F.coalesce("harm_at_alarm", "harm_counterfactual").alias("harm_final"), "harm_counterfactual")
    out = metrics.detection_report(checkpoint(eps))
    fours = ("weighted_harm_at_alarm", "kappa_mae")
    return out.select(*(F.col(c) if c.startswith("n_") else F.round(c, 4 if c in fours else 6).alias(c) for c in out.columns))


@query("policy_verdict", f"""WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(THETA)},
free AS (SELECT s.sample, start.node FROM start, (SELECT unnest(range({THETA})) AS sample) s UNION SELECT l.sample, l.dst FROM free r JOIN live l ON l.sample = r.sample AND l.src = r.node),
by_reach AS (SELECT r.node FROM free r JOIN deg d ON d.node = r.node WHERE r.node NOT IN (SELECT node FROM start) GROUP BY r.node, d.deg ORDER BY count(*) * (1 + d.deg) DESC, r.node LIMIT 5),
by_degree AS (SELECT node FROM deg WHERE node NOT IN (SELECT node FROM start) ORDER BY deg DESC, node LIMIT 5),
plans AS (SELECT 'reach' AS policy, node FROM by_reach UNION ALL SELECT 'degree', node FROM by_degree),
held AS (SELECT p.policy, s.sample, start.node FROM start, (SELECT unnest(range({THETA})) AS sample) s, (SELECT unnest(['none', 'reach', 'degree']) AS policy) p
  UNION SELECT r.policy, r.sample, l.dst FROM held r JOIN live l ON l.sample = r.sample AND l.src = r.node WHERE NOT EXISTS (SELECT 1 FROM plans x WHERE x.policy = r.policy AND x.node = l.dst)),
sizes AS (SELECT sample, count(*) FILTER (WHERE policy = 'none') AS n, count(*) FILTER (WHERE policy = 'reach') AS a, count(*) FILTER (WHERE policy = 'degree') AS b FROM held GROUP BY sample),
v AS (SELECT count(*) AS n, 1 - sum(a) / sum(n)::DOUBLE AS sa, 1 - sum(b) / sum(n)::DOUBLE AS sb, avg(b - a) AS gain, stddev_samp(b - a) / sqrt(count(*)) AS se, 100 * sum(b - a) / sum(n)::DOUBLE AS pct FROM sizes)
SELECT n, round(sa, 6) AS reach_saved, round(sb, 6) AS degree_saved, round(gain, 6) AS gain, round(se, 6) AS se, round(pct, 6) AS pct, round(CASE WHEN se > 0 THEN gain / se END, 4) AS z, CASE WHEN se > 0 AND gain / se > 2 THEN 'reach wins' WHEN se > 0 AND gain / se < -2 THEN 'degree wins' ELSE 'tie' END AS verdict FROM v""")  # fmt: skip
def policy_verdict(spark, sf_dir):
    """Five nodes by reach and degree against the five of largest degree, world by world."""
    edges, _, start, reached, live = spread_of(spark, sf_dir)
    plans = {"reach": blocking.reach_blocker(edges, reached, start, 5), "degree": blocking.degree_blocker(edges, start, 5)}
    none = reached.groupBy("sample").agg(F.count("*").alias("spread")).withColumn("policy", F.lit("none"))
    shut = checkpoint(reduce(DataFrame.unionByName, (p.select(F.lit(name).alias("policy"), "node") for name, p in plans.items())))
    starts = start.select("node", F.explode(F.sequence(F.lit(0), F.lit(THETA - 1))).alias("sample")).select("sample", "node", F.explode(F.array(*(F.lit(p) for p in plans))).alias("policy"))
    held = graph.explore(live, starts, keys=["policy", "sample"], outside=shut)[0].groupBy("policy", "sample").agg(F.count("*").alias("spread"))
    out = metrics.policy_verdict(held.unionByName(none), "reach", "degree", ["sample"])
    return out.select("n", *(F.round(c, 4 if c == "z" else 6).alias(c) for c in ("reach_saved", "degree_saved", "gain", "se", "pct", "z")), "verdict")


@query("trivial_alarms", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES} SELECT 'immediate' AS detector, cascade, 1 AS alarm_round FROM cascades")
def trivial_alarms(spark, sf_dir):
    """The two detectors that look at nothing: one never fires, the other fires at once."""
    cascades = running_cascades(spark, sf_dir)[1]
    both = {"never": sequential.never(cascades), "immediate": sequential.immediate(cascades)}
    return reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("detector"), "cascade", "alarm_round") for name, d in both.items()))


@query("union_of_worlds", f"WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(THETA)}, reach AS (SELECT s.sample, start.node FROM start, (SELECT unnest(range({THETA})) AS sample) s UNION SELECT l.sample, l.dst FROM reach r JOIN live l ON l.sample = r.sample AND l.src = r.node) SELECT l.src, l.dst, count(*) AS worlds FROM live l JOIN reach r ON r.sample = l.sample AND r.node = l.src GROUP BY l.src, l.dst")
def union_of_worlds(spark, sf_dir):
    """The arcs that are live in any world that the hub's cascades meet, with the number of these worlds."""
    return worlds_of(spark, sf_dir)[2].groupBy("src", "dst").agg(F.count("*").alias("worlds"))
