"""The registered queries: operators applied to the contact graph of the star schema, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, kept
from diffspark.functions.rng import uniform, uniform_sql
from diffspark.operators import blocking, containment, detect, diffusion, graph, metrics, sequential
from diffspark.operators.message_passing import message_passing
from diffspark.plans.registry import query
from diffspark.sources import graphs

SEED = 7
THETA = 32
EDGES = """contact AS (
  SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT a AS src, b AS dst FROM contact UNION ALL SELECT b, a FROM contact),
deg AS (SELECT src AS node, count(*) AS deg FROM edges GROUP BY src)"""
START = "start AS (SELECT node FROM deg ORDER BY deg DESC, node LIMIT 1)"
WC = "arcs AS (SELECT e.src, e.dst, 1.0::DOUBLE / d.deg AS p FROM edges e JOIN deg d ON d.node = e.dst)"


def hops_sql(name: str, starts: str, arcs: str = "edges", keys: tuple[str, ...] = (), count: str = "dist") -> str:
    """Breadth-first hops by a recursive table that keeps one row for each key and node."""
    own = "".join(f"{k}, " for k in keys)
    same = "".join(f" AND r.{k} = f.{k}" for k in keys)
    met = "".join(f" AND a.{k} = f.{k}" for k in keys) if arcs != "edges" else ""
    return f"""{name}({own}node, {count}) USING KEY ({own}node) AS (SELECT {own}node, 0 FROM {starts}
  UNION SELECT {"".join(f"f.{k}, " for k in keys)}a.dst, f.{count} + 1 FROM {name} f JOIN {arcs} a ON a.src = f.node{met} WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.node = a.dst{same}))"""


def live_sql(theta: int) -> str:
    return f"live AS (SELECT s.sample, a.src, a.dst FROM arcs a, (SELECT unnest(range({theta})) AS sample) s WHERE {uniform_sql(SEED, 's.sample', 'a.src', 'a.dst')} < a.p)"


def reach_sql(theta: int) -> str:
    return f"reach AS (SELECT s.sample, start.node FROM start, (SELECT unnest(range({theta})) AS sample) s UNION SELECT l.sample, l.dst FROM reach r JOIN live l ON l.sample = r.sample AND l.src = r.node)"


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(graphs.contact_graph(spark, sf_dir))


def hub(edges: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` nodes of largest degree, ties to the lower id."""
    return graph.top(graph.degrees(edges), k, F.col("deg").desc(), F.col("node")).select("node")


def spread_of(spark: SparkSession, sf_dir: str, theta: int = THETA) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges, arcs with weighted-cascade probabilities, the hub, what it reaches in each world, and the live arcs that leave it."""
    edges = edges_of(spark, sf_dir)
    arcs = kept(diffusion.edge_probabilities(edges, "wc"))
    start = checkpoint(hub(edges))
    reached, live = diffusion.worlds_from(arcs, start, theta, seed=SEED)
    return edges, arcs, start, reached, checkpoint(live)


def worlds_of(spark: SparkSession, sf_dir: str, theta: int = THETA) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges, arcs, the live arcs that the hub's cascades meet, the hub."""
    edges, arcs, start, _, live = spread_of(spark, sf_dir, theta)
    return edges, arcs, live, start


@query("degree", f"WITH {EDGES} SELECT node, deg FROM deg")
def degree(spark, sf_dir):
    return graph.degrees(graphs.contact_graph(spark, sf_dir))


@query("adjacency_lists", f"WITH {EDGES} SELECT src, array_to_string(list(dst ORDER BY dst), ',') AS neighbours FROM edges GROUP BY src")
def adjacency_lists(spark, sf_dir):
    return graphs.adjacency(graphs.contact_graph(spark, sf_dir)).select("src", F.array_join("neighbours", ",").alias("neighbours"))


@query("relabel", f"WITH {EDGES}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM deg) SELECT x.id AS src, y.id AS dst FROM edges JOIN ids x ON x.node = src JOIN ids y ON y.node = dst WHERE src < dst")
def relabel(spark, sf_dir):
    edges = graphs.contact_graph(spark, sf_dir)
    once = edges.where("src < dst")
    ids = edges.select("src").distinct().select(F.col("src").alias("line"), F.col("src"), F.col("src").alias("dst"))
    named = graphs.relabel_by_appearance(ids.unionByName(once.select(F.lit(1 << 62).cast("long").alias("line"), "src", "dst")))
    return named.where("src <> dst")


# Each node's least label within 12 hops; the contact graph's components are far less wide.
_LABELS = ",\n".join(["c0 AS (SELECT node, node AS label FROM deg)"] + [f"c{i + 1} AS MATERIALIZED (SELECT c.node, least(c.label, min(o.label)) AS label FROM c{i} c JOIN edges e ON e.src = c.node JOIN c{i} o ON o.node = e.dst GROUP BY c.node, c.label)" for i in range(12)])


@query("graph_stats", f"""WITH RECURSIVE {EDGES},
{_LABELS},
comp AS (SELECT node, label AS component FROM c12),
sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
SELECT (SELECT count(*) FROM deg) AS n, (SELECT CAST(sum(deg) / 2 AS BIGINT) FROM deg) AS m, (SELECT avg(deg) FROM deg) AS avg_degree,
       count(*) AS n_components, max(size) AS lcc FROM sizes""")  # fmt: skip
def graph_stats(spark, sf_dir):
    return graph.graph_stats(edges_of(spark, sf_dir))


@query("bfs_hops", f"WITH RECURSIVE {EDGES}, {START}, {hops_sql('walk', 'start')} SELECT node, dist FROM walk")
def bfs_hops(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return graph.reach(edges, hub(edges))


@query("multi_source_hops", f"WITH RECURSIVE {EDGES}, start AS (SELECT node FROM deg ORDER BY deg DESC, node LIMIT 5), {hops_sql('walk', 'start')} SELECT node, dist FROM walk")
def multi_source_hops(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return graph.reach(edges, hub(edges, 5))


_RANKS = ",\n".join(["r0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS rank FROM deg)"] + [f"r{i + 1} AS (SELECT e.dst AS node, 0.15::DOUBLE / (SELECT count(*) FROM deg) + 0.85::DOUBLE * sum(r.rank / d.deg) AS rank FROM edges e JOIN r{i} r ON r.node = e.src JOIN deg d ON d.node = e.src GROUP BY e.dst)" for i in range(10)])


@query("pagerank", f"WITH {EDGES}, {_RANKS} SELECT node, CAST(round(rank * 1e9) AS BIGINT) AS rank_e9 FROM r10")
def pagerank(spark, sf_dir):
    ranks = graph.pagerank(edges_of(spark, sf_dir), iterations=10)
    return ranks.select("node", F.round(F.col("rank") * 1e9).cast("long").alias("rank_e9"))


@query("edge_prob_wc", f"WITH {EDGES}, {WC} SELECT src, dst, p FROM arcs")
def edge_prob_wc(spark, sf_dir):
    return diffusion.edge_probabilities(graphs.contact_graph(spark, sf_dir), "wc")


_U = uniform_sql(SEED, "src", "dst")


@query("edge_prob_tri", f"WITH {EDGES} SELECT src, dst, CASE WHEN {_U} < 1.0::DOUBLE / 3 THEN 0.1::DOUBLE WHEN {_U} < 2.0::DOUBLE / 3 THEN 0.01::DOUBLE ELSE 0.001::DOUBLE END AS p FROM edges")
def edge_prob_tri(spark, sf_dir):
    return diffusion.edge_probabilities(graphs.contact_graph(spark, sf_dir), "tri", seed=SEED)


@query("edge_prob_bimodal", f"WITH {EDGES} SELECT src, dst, least(1.0::DOUBLE, 1.5::DOUBLE * CASE WHEN {_U} < 0.1::DOUBLE THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END) AS p FROM edges")
def edge_prob_bimodal(spark, sf_dir):
    return diffusion.scaled(diffusion.edge_probabilities(graphs.contact_graph(spark, sf_dir), "bimodal", p=0.1, seed=SEED), 1.5)


@query("live_edges", f"WITH {EDGES}, {WC}, {live_sql(8)} SELECT sample, src, dst FROM live")
def live_edges(spark, sf_dir):
    return diffusion.live_arcs(diffusion.edge_probabilities(edges_of(spark, sf_dir), "wc"), 8, seed=SEED)


_COIN = uniform_sql(SEED, "s.sample", "least(src, dst)", "greatest(src, dst)")


@query("live_undirected", f"WITH {EDGES} SELECT s.sample, src, dst FROM edges, (SELECT unnest(range(8)) AS sample) s WHERE {_COIN} < 0.3::DOUBLE")
def live_undirected(spark, sf_dir):
    return diffusion.live_arcs(diffusion.edge_probabilities(edges_of(spark, sf_dir), "const", p=0.3), 8, seed=SEED, undirected=True)


@query("ic_reach", f"WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(THETA)}, {reach_sql(THETA)} SELECT sample, count(*) AS n FROM reach GROUP BY sample")
def ic_reach(spark, sf_dir):
    return spread_of(spark, sf_dir)[3].groupBy("sample").agg(F.count("*").alias("n"))


@query("spread_blocked", f"""WITH RECURSIVE {EDGES}, {START}, {WC}, blocked AS (SELECT node FROM deg WHERE node NOT IN (SELECT node FROM start) ORDER BY deg DESC, node LIMIT 5),
live AS (SELECT s.sample, a.src, a.dst FROM arcs a, (SELECT unnest(range({THETA})) AS sample) s WHERE {uniform_sql(SEED, 's.sample', 'a.src', 'a.dst')} < a.p AND a.src NOT IN (SELECT node FROM blocked) AND a.dst NOT IN (SELECT node FROM blocked)),
{reach_sql(THETA)} SELECT count(*) / {THETA}.0::DOUBLE AS spread FROM reach""")  # fmt: skip
def spread_blocked(spark, sf_dir):
    edges, _, live, start = worlds_of(spark, sf_dir)
    return diffusion.expected_spread(live, start, THETA, blocked=checkpoint(blocking.degree_blocker(edges, start, 5).select("node")))


@query("random_blocker", f"WITH {EDGES}, {START} SELECT node FROM deg WHERE node NOT IN (SELECT node FROM start) ORDER BY {uniform_sql(SEED, chr(39) + 'block' + chr(39), 'node')}, node LIMIT 10")
def random_blocker(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return blocking.random_blocker(edges, hub(edges), 10, seed=SEED).select("node")


@query("degree_blocker", f"WITH {EDGES}, {START} SELECT node, deg FROM deg WHERE node NOT IN (SELECT node FROM start) ORDER BY deg DESC, node LIMIT 10")
def degree_blocker(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return blocking.degree_blocker(edges, hub(edges), 10)


@query("pagerank_blocker", f"WITH {EDGES}, {START}, {_RANKS} SELECT node FROM r10 WHERE node NOT IN (SELECT node FROM start) ORDER BY round(rank, 9) DESC, node LIMIT 10")
def pagerank_blocker(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return blocking.pagerank_blocker(edges, hub(edges), 10, iterations=10).select("node")


@query("proximity_blocker", f"""WITH RECURSIVE {EDGES}, {START},
{hops_sql('walk', 'start')}
SELECT h.node, h.dist, d.deg FROM walk h JOIN deg d ON d.node = h.node WHERE h.dist > 0 ORDER BY h.dist, d.deg DESC, h.node LIMIT 10""")  # fmt: skip
def proximity_blocker(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return blocking.proximity_blocker(edges, hub(edges), 10)


@query("reach_blocker", f"""WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(THETA)}, {reach_sql(THETA)}
SELECT r.node, count(*) AS cnt, d.deg, count(*) * (1 + d.deg) AS score FROM reach r JOIN deg d ON d.node = r.node
WHERE r.node NOT IN (SELECT node FROM start) GROUP BY r.node, d.deg ORDER BY score DESC, r.node LIMIT 10""")  # fmt: skip
def reach_blocker(spark, sf_dir):
    edges, _, start, reached, _ = spread_of(spark, sf_dir)
    return blocking.reach_blocker(edges, reached, start, 10)


@query("dominator_gains", f"""WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(8)}, {reach_sql(8)},
pool AS (SELECT sample, node AS cut FROM reach WHERE node NOT IN (SELECT node FROM start)),
without AS (SELECT p.sample, p.cut, start.node FROM pool p, start UNION SELECT w.sample, w.cut, l.dst FROM without w JOIN live l ON l.sample = w.sample AND l.src = w.node AND l.dst <> w.cut),
sizes AS (SELECT sample, count(*) AS n FROM reach GROUP BY sample)
SELECT w.sample, w.cut AS node, s.n - count(*) AS gain FROM without w JOIN sizes s ON s.sample = w.sample GROUP BY w.sample, w.cut, s.n""")  # fmt: skip
def dominator_gains(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir, 8)
    return blocking.block_gains(live, start)


def _first_pick_sql(theta: int) -> str:
    return f"""WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(theta)}, {reach_sql(theta)},
pool AS (SELECT DISTINCT sample, node AS cut FROM reach WHERE node NOT IN (SELECT node FROM start)),
without AS (SELECT p.sample, p.cut, start.node FROM pool p, start UNION SELECT w.sample, w.cut, l.dst FROM without w JOIN live l ON l.sample = w.sample AND l.src = w.node AND l.dst <> w.cut),
sizes AS (SELECT sample, count(*) AS n FROM reach GROUP BY sample),
gains AS (SELECT w.sample, w.cut, s.n - count(*) AS gain FROM without w JOIN sizes s ON s.sample = w.sample GROUP BY w.sample, w.cut, s.n)
"""


@query("greedy_first_pick", _first_pick_sql(16) + "SELECT 1 AS rank, cut AS node, CAST(sum(gain) AS BIGINT) AS gain FROM gains GROUP BY cut ORDER BY gain DESC, node LIMIT 1")
def greedy_first_pick(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir, 16)
    return blocking.advanced_greedy(live, start, 1)


@query("lcb_first_pick", _first_pick_sql(16) + """, t AS (SELECT cut, sum(gain) / 16.0::DOUBLE AS m, sum(gain * gain) / 16.0::DOUBLE AS q FROM gains GROUP BY cut)
SELECT 1 AS rank, cut AS node, round(m - sqrt(greatest(0.0, q - m * m) / 15), 6) AS gain FROM t ORDER BY round(m - sqrt(greatest(0.0, q - m * m) / 15), 9) DESC, node LIMIT 1""")  # fmt: skip
def lcb_first_pick(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir, 16)
    return blocking.scored_pick(live, start, 16, blocking.lower_bound(1.0)).withColumn("gain", F.round("gain", 6))


@query("isolation_gains", _first_pick_sql(8).replace("pool AS (SELECT DISTINCT sample, node AS cut FROM reach WHERE node NOT IN (SELECT node FROM start))", "pool AS (SELECT DISTINCT sample, node AS cut FROM reach WHERE node NOT IN (SELECT node FROM start))") + """, t AS (SELECT cut AS node, FALSE AS is_source, CAST(sum(gain) AS BIGINT) AS gain, 1 AS cost FROM gains GROUP BY cut
UNION ALL SELECT s.node, TRUE, (SELECT CAST(sum(n - 1) AS BIGINT) FROM sizes WHERE n > 1), d.deg FROM start s JOIN deg d ON d.node = s.node)
SELECT node, is_source, gain, CAST(cost AS BIGINT) AS cost, gain / cost::DOUBLE AS ratio FROM t""")  # fmt: skip
def isolation_gains(spark, sf_dir):
    _, arcs, live, start = worlds_of(spark, sf_dir, 8)
    return blocking.isolation(live, start, arcs).withColumn("cost", F.col("cost").cast("long"))


def picks_sql(theta: int, k: int) -> str:
    """Greedy picks p1 to pk, each by what blocking it would save in the worlds that the picks before leave; z1 to zk: sizes of these worlds' reach."""
    parts = [f"WITH RECURSIVE {EDGES}, {START}, {WC}, {live_sql(theta)}, worlds AS (SELECT unnest(range({theta})) AS sample), l1 AS (SELECT * FROM live)"]
    for i in range(1, k + 1):
        parts.append(f"""r{i} AS (SELECT s.sample, start.node FROM start, worlds s UNION SELECT l.sample, l.dst FROM r{i} r JOIN l{i} l ON l.sample = r.sample AND l.src = r.node),
w{i} AS (SELECT r.sample, r.node AS cut, start.node FROM r{i} r, start WHERE r.node <> start.node UNION SELECT w.sample, w.cut, l.dst FROM w{i} w JOIN l{i} l ON l.sample = w.sample AND l.src = w.node AND l.dst <> w.cut),
z{i} AS (SELECT sample, count(*) AS n FROM r{i} GROUP BY sample),
g{i} AS (SELECT w.sample, w.cut, s.n - count(*) AS gain FROM w{i} w JOIN z{i} s ON s.sample = w.sample GROUP BY w.sample, w.cut, s.n),
p{i} AS MATERIALIZED (SELECT cut AS node, CAST(sum(gain) AS BIGINT) AS gain FROM g{i} GROUP BY cut ORDER BY gain DESC, cut LIMIT 1),
l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE src NOT IN (SELECT node FROM p{i}) AND dst NOT IN (SELECT node FROM p{i}))""")
    return ",\n".join(parts)


@query("ag_plan", picks_sql(THETA, 4) + " " + " UNION ALL ".join(f"SELECT {i} AS rank, node, gain FROM p{i} WHERE gain > 0" for i in range(1, 5)))
def ag_plan(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir)
    return blocking.advanced_greedy(live, start, 4)


@query("gr_plan")
def gr_plan(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir)
    return blocking.greedy_replace(live, start, 3)


def coverage_sql(theta: int, k: int) -> str:
    parts = [picks_sql(theta, 1), """d1 AS MATERIALIZED (SELECT c.sample, c.node, v.node AS covered FROM r1 c JOIN r1 v ON v.sample = c.sample
  WHERE c.node NOT IN (SELECT node FROM start) AND v.node NOT IN (SELECT node FROM start) AND NOT EXISTS (SELECT 1 FROM w1 w WHERE w.sample = c.sample AND w.cut = c.node AND w.node = v.node))"""]
    for i in range(1, k + 1):
        parts.append(f"""b{i} AS MATERIALIZED (SELECT node, count(*) AS gain FROM d{i} GROUP BY node ORDER BY gain DESC, node LIMIT 1),
d{i + 1} AS MATERIALIZED (SELECT * FROM d{i} p WHERE NOT EXISTS (SELECT 1 FROM d{i} q, b{i} b WHERE q.node = b.node AND q.sample = p.sample AND q.covered = p.covered))""")
    return ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS rank, node, gain FROM b{i}" for i in range(1, k + 1))


@query("coverage_plan", coverage_sql(THETA, 4))
def coverage_plan(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir)
    return blocking.max_coverage(live, start, 4)


@query("cross_validated_pick", _first_pick_sql(16) + """, h AS (SELECT cut, coalesce(sum(gain) FILTER (WHERE sample < 8), 0) AS a, coalesce(sum(gain) FILTER (WHERE sample >= 8), 0) AS b FROM gains GROUP BY cut),
short AS (SELECT * FROM h ORDER BY a DESC, cut LIMIT 10) SELECT 1 AS rank, cut AS node, CAST(b AS DOUBLE) AS gain FROM short ORDER BY b DESC, cut LIMIT 1""")  # fmt: skip
def cross_validated_pick(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir, 16)
    return blocking.scored_pick(live, start, 16, blocking.cross_validated(10))


@query("control_variate_gains", _first_pick_sql(16) + """, near AS (SELECT a.dst AS node, a.p AS q FROM arcs a JOIN start ON a.src = start.node),
hit AS (SELECT l.sample, l.dst AS node FROM live l JOIN start ON l.src = start.node),
tot AS (SELECT cut AS node, sum(gain) AS g FROM gains GROUP BY cut),
m AS (SELECT n.node, n.q, coalesce(t.g, 0) AS g, (SELECT count(*) FROM hit h WHERE h.node = n.node) AS h,
  coalesce((SELECT sum(x.gain) FROM gains x JOIN hit h ON h.sample = x.sample AND h.node = x.cut WHERE x.cut = n.node), 0) AS gh FROM near n LEFT JOIN tot t ON t.node = n.node),
s AS (SELECT *, (gh - g * h / 16.0::DOUBLE) / 15.0::DOUBLE AS cov, (h - h * h / 16.0::DOUBLE) / 15.0::DOUBLE AS var FROM m),
f AS (SELECT *, (16.0::DOUBLE * CASE WHEN var > 0 THEN cov / var ELSE 0 END + 5.0::DOUBLE * (SELECT sum(cov) / greatest(sum(var), 1e-12::DOUBLE) FROM s)) / 21.0::DOUBLE AS slope FROM s)
SELECT node, round(greatest(0.0::DOUBLE, g / 16.0::DOUBLE - slope * (h / 16.0::DOUBLE - q)), 6) AS gain FROM f
UNION ALL SELECT node, round(g / 16.0::DOUBLE, 6) FROM tot WHERE node NOT IN (SELECT node FROM near)""")  # fmt: skip
def control_variate_gains(spark, sf_dir):
    _, arcs, live, start = worlds_of(spark, sf_dir, 16)
    return blocking.control_variate_gains(live, start, arcs, 16).withColumn("gain", F.round("gain", 6))


@query("cost_aware_plan")
def cost_aware_plan(spark, sf_dir):
    """Moves against a strong spread from the node of least degree, whose neighbours may all be blocked at once."""
    edges = edges_of(spark, sf_dir)
    arcs = kept(diffusion.scaled(diffusion.edge_probabilities(edges, "wc"), 200.0))
    start = checkpoint(graph.top(graph.degrees(edges), 1, F.col("deg"), F.col("node")).select("node"))
    return blocking.cost_aware_plan(checkpoint(diffusion.worlds_from(arcs, start, 8, seed=SEED)[1]), start, arcs, 16)


_SAVED = """WITH RECURSIVE """ + f"{EDGES}, {START}, {WC}, {live_sql(THETA)}, order_of AS (SELECT node, row_number() OVER (ORDER BY deg DESC, node) AS r FROM deg WHERE node NOT IN (SELECT node FROM start))," + f"""
plans AS (SELECT b AS budget, s.sample FROM (VALUES (0), (1), (3), (5)) v(b), (SELECT unnest(range({THETA})) AS sample) s),
reach AS (SELECT p.budget, p.sample, start.node FROM plans p, start UNION SELECT r.budget, r.sample, l.dst FROM reach r JOIN live l ON l.sample = r.sample AND l.src = r.node JOIN deg d ON d.node = l.dst LEFT JOIN order_of o ON o.node = l.dst WHERE o.r IS NULL OR o.r > r.budget),
spread AS (SELECT budget, count(*) / {THETA}.0::DOUBLE AS after FROM reach GROUP BY budget)
SELECT CAST(a.budget AS INTEGER) AS budget, b.after AS base, a.after, 1 - a.after / b.after AS saved_frac, a.after / (SELECT count(*) FROM deg) AS bad_frac FROM spread a, spread b WHERE b.budget = 0 AND a.budget > 0"""


@query("saved_fraction", _SAVED)
def saved_fraction(spark, sf_dir):
    edges, _, live, start = worlds_of(spark, sf_dir)
    ranking = blocking.degree_blocker(edges, start, 5).withColumn("rank", F.row_number().over(W.orderBy(F.col("deg").desc(), "node")))
    return metrics.saved_fraction(live, start, THETA, ranking, [1, 3, 5], graph.degrees(edges).count())


@query("swap_plan")
def swap_plan(spark, sf_dir):
    edges, _, live, start = worlds_of(spark, sf_dir)
    first = blocking.degree_blocker(edges, start, 2).withColumn("rank", F.row_number().over(W.orderBy(F.col("deg").desc(), "node")))
    return blocking.best_swaps(live, start, first)


@query("removal_plan", picks_sql(8, 2) + " " + " UNION ALL ".join(f"SELECT {i} AS rank, node, CAST((SELECT sum(n) FROM z{i}) - gain AS BIGINT) AS spread FROM p{i}" for i in (1, 2)))
def removal_plan(spark, sf_dir):
    _, _, live, start = worlds_of(spark, sf_dir, 8)
    return blocking.greedy_by_removal(live, start, 8, 2)


@query("world_cuts")
def world_cuts(spark, sf_dir):
    edges, _, live, start = worlds_of(spark, sf_dir)
    far = graph.reach(edges, start).where("dist > 2").join(graph.degrees(edges), "node")
    targets = [r["node"] for r in graph.top(far, 20, F.col("deg").desc(), F.col("node")).collect()]
    return blocking.world_cuts(live, start, targets)


# Epidemics and source detection: 2 outbreaks from each of the 6 largest hubs, with their infected seen at a time.
SIMS, BETA, HORIZON = 2, 0.02, 0.85
_REC = f"(-ln(1 - {uniform_sql(SEED, chr(39) + 'rec' + chr(39), '{s}.sim_id', '{s}.node')}))"
_DELAY = f"(-ln(1 - {uniform_sql(SEED, chr(39) + 'arc' + chr(39), 'w.sim_id', 'e.src', 'e.dst')}) / {BETA}::DOUBLE)"
SIR = f"""hubs AS (SELECT node FROM deg ORDER BY deg DESC, node LIMIT 6),
truth AS (SELECT node * {SIMS} + s AS sim_id, node AS source FROM hubs, (SELECT unnest(range({SIMS})) AS s)),
walk AS (SELECT sim_id, source AS node, 0.0::DOUBLE AS t FROM truth
  UNION SELECT w.sim_id, e.dst, w.t + {_DELAY} FROM walk w JOIN edges e ON e.src = w.node
  WHERE {_DELAY} < {_REC.replace('{s}', 'w')} AND w.t + {_DELAY} <= {HORIZON}),
times AS (SELECT w.sim_id, w.node, min(w.t) AS inf_time, min(w.t) + {_REC.replace('{s}', 'w')} AS rec_time FROM walk w GROUP BY w.sim_id, w.node),
snap AS (SELECT sim_id, node, CASE WHEN rec_time <= {HORIZON} THEN 2 ELSE 1 END AS state FROM times)"""


def epidemic(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges, outbreaks, times, snapshot"""
    edges = edges_of(spark, sf_dir)
    runs = checkpoint(diffusion.outbreaks(hub(edges, 6), SIMS, beta=BETA))
    times = checkpoint(diffusion.sir_times(edges, runs, horizon=HORIZON, seed=SEED))
    return edges, runs, times, diffusion.snapshot(times, HORIZON)


@query("sir_times", f"WITH RECURSIVE {EDGES}, {SIR} SELECT sim_id, node, CAST(round(inf_time * 1e6) AS BIGINT) AS inf_us, CAST(round(rec_time * 1e6) AS BIGINT) AS rec_us FROM times")
def sir_times(spark, sf_dir):
    times = epidemic(spark, sf_dir)[2]
    return times.select("sim_id", "node", *(F.round(F.col(c) * 1e6).cast("long").alias(a) for c, a in (("inf_time", "inf_us"), ("rec_time", "rec_us"))))


@query("sir_snapshot", f"WITH RECURSIVE {EDGES}, {SIR} SELECT sim_id, node, state FROM snap")
def sir_snapshot(spark, sf_dir):
    return epidemic(spark, sf_dir)[3]


@query("induced_subgraph", f"WITH RECURSIVE {EDGES}, {SIR} SELECT a.sim_id, e.src, e.dst FROM snap a JOIN edges e ON e.src = a.node JOIN snap b ON b.sim_id = a.sim_id AND b.node = e.dst")
def induced_subgraph(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return graph.induced(edges, snap, ["sim_id"])


@query("source_random", f"WITH RECURSIVE {EDGES}, {SIR} SELECT sim_id, node, round(-ln(count(*) OVER (PARTITION BY sim_id)), 9) AS score FROM snap")
def source_random(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return detect.random(edges, snap).withColumn("score", F.round("score", 9))


@query("source_degree", f"WITH RECURSIVE {EDGES}, {SIR} SELECT s.sim_id, s.node, CAST(count(b.node) AS DOUBLE) AS score FROM snap s LEFT JOIN edges e ON e.src = s.node LEFT JOIN snap b ON b.sim_id = s.sim_id AND b.node = e.dst GROUP BY s.sim_id, s.node")
def source_degree(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return detect.degree(edges, snap)


_HOPS = f"""WITH RECURSIVE {EDGES}, {SIR},
inner_arcs AS (SELECT a.sim_id, e.src, e.dst FROM snap a JOIN edges e ON e.src = a.node JOIN snap b ON b.sim_id = a.sim_id AND b.node = e.dst),
near(sim_id, root, node, dist) USING KEY (sim_id, root, node) AS (SELECT sim_id, node, node, 0 FROM snap UNION SELECT h.sim_id, h.root, i.dst, h.dist + 1 FROM near h JOIN inner_arcs i ON i.sim_id = h.sim_id AND i.src = h.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.near r WHERE r.sim_id = h.sim_id AND r.root = h.root AND r.node = i.dst)),
per AS (SELECT n.sim_id, n.root AS node, max(dist) AS far, sum(dist) AS total, count(*) AS reached, (SELECT count(*) FROM snap s WHERE s.sim_id = n.sim_id) AS n_inf FROM near n GROUP BY n.sim_id, n.root)
"""


@query("source_jordan", _HOPS + "SELECT sim_id, node, CAST(-(far + 1000 * (n_inf - reached)) AS DOUBLE) AS score FROM per")
def source_jordan(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return detect.jordan(edges, snap)


@query("source_distance", _HOPS + "SELECT sim_id, node, CAST(-(total + 1000 * (n_inf - reached)) AS DOUBLE) AS score FROM per")
def source_distance(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return detect.distance(edges, snap)


@query("source_closeness", _HOPS + "SELECT sim_id, node, CASE WHEN total > 0 AND n_inf > 1 THEN (reached - 1) / total::DOUBLE * (reached - 1) / (n_inf - 1) ELSE 0.0::DOUBLE END AS score FROM per")
def source_closeness(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return detect.closeness(edges, snap)


def _detector(name: str):
    @query(f"source_{name}")
    def run(spark, sf_dir):
        edges, _, _, snap = epidemic(spark, sf_dir)
        return detect.DETECTORS[name](edges, snap)

    return run


source_betweenness, source_rumor, source_netsleuth = map(_detector, ("betweenness", "rumor", "netsleuth"))


def training(spark, sf_dir, sims: int = 8):
    """edges, snapshot, training states (source, sim, node, state) from the nodes infected in it, sims for each source, number of nodes."""
    edges, _, _, snap = epidemic(spark, sf_dir)
    nodes = snap.select("node").distinct()
    runs = checkpoint(diffusion.outbreaks(nodes, sims, beta=BETA, seed=SEED))
    states = diffusion.snapshot(diffusion.sir_times(edges, runs, horizon=HORIZON, seed=SEED + 1), HORIZON)
    train = checkpoint(states.join(runs.select("sim_id", "source"), "sim_id").select("source", F.col("sim_id").alias("sim"), "node", "state"))
    return edges, checkpoint(snap), train, runs.groupBy("source").agg(F.count("*").alias("sims")), graph.degrees(edges).count()


_TRAIN = f"""{_HOPS}, pool AS (SELECT DISTINCT node FROM snap), drawn AS (SELECT node * 8 + s AS sim_id, node AS source FROM pool, (SELECT unnest(range(8)) AS s)),
tw AS (SELECT sim_id, source AS node, 0.0::DOUBLE AS t FROM drawn
  UNION SELECT w.sim_id, e.dst, w.t + {_DELAY.replace(f"'{SEED}'", f"'{SEED + 1}'")} FROM tw w JOIN edges e ON e.src = w.node
  WHERE {_DELAY.replace(f"'{SEED}'", f"'{SEED + 1}'")} < {_REC.replace('{s}', 'w').replace(f"'{SEED}'", f"'{SEED + 1}'")} AND w.t + {_DELAY.replace(f"'{SEED}'", f"'{SEED + 1}'")} <= {HORIZON}),
tt AS (SELECT w.sim_id, w.node, min(w.t) + {_REC.replace('{s}', 'w').replace(f"'{SEED}'", f"'{SEED + 1}'")} AS rec_time FROM tw w GROUP BY w.sim_id, w.node),
train AS (SELECT d.source, t.sim_id AS sim, t.node, CASE WHEN t.rec_time <= {HORIZON} THEN 2 ELSE 1 END AS state FROM tt t JOIN drawn d ON d.sim_id = t.sim_id)"""
_MONTE = """, seen AS (SELECT source, node, count(*) FILTER (WHERE state = 1) AS c1, count(*) FILTER (WHERE state = 2) AS c2 FROM train GROUP BY source, node),
cells AS (SELECT c.sim_id, c.node AS cand, d.node, coalesce(o.state, 0) AS state, coalesce(s.c1, 0) AS c1, coalesce(s.c2, 0) AS c2
  FROM snap c CROSS JOIN deg d LEFT JOIN snap o ON o.sim_id = c.sim_id AND o.node = d.node LEFT JOIN seen s ON s.source = c.node AND s.node = d.node),
monte AS (SELECT sim_id, cand AS node, sum(ln((CASE state WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE 8 - c1 - c2 - CASE WHEN cand = node THEN 1 ELSE 0 END END + 1) / 11.0::DOUBLE)) AS score FROM cells GROUP BY sim_id, cand)"""


@query("source_monte_carlo", _TRAIN + _MONTE + " SELECT sim_id, node, round(score, 6) AS score FROM monte")
def source_monte_carlo(spark, sf_dir):
    _, snap, train, sims, n = training(spark, sf_dir)
    return detect.monte_carlo(train, sims, snap, n).withColumn("score", F.round("score", 6))


_SOFT = """, sizes AS (SELECT source, sim, count(*) AS size FROM train GROUP BY source, sim), own AS (SELECT sim_id, count(*) AS n_inf FROM snap GROUP BY sim_id),
jac AS (SELECT z.source, z.sim, o.sim_id, c.common / (z.size + o.n_inf - c.common)::DOUBLE AS j FROM sizes z CROSS JOIN own o
  LEFT JOIN (SELECT s.sim_id, t.source, t.sim, count(*) AS common FROM snap s JOIN train t ON t.node = s.node GROUP BY s.sim_id, t.source, t.sim) c ON c.sim_id = o.sim_id AND c.source = z.source AND c.sim = z.sim)"""


@query("source_soft_margin", _TRAIN + _SOFT + " SELECT j.sim_id, j.source AS node, round(avg(exp(-pow(coalesce(j, 0) - 1, 2) / 0.25::DOUBLE)), 9) AS score FROM jac j JOIN snap s ON s.sim_id = j.sim_id AND s.node = j.source WHERE EXISTS (SELECT 1 FROM jac k WHERE k.sim_id = j.sim_id AND k.source = j.source AND k.j IS NOT NULL) GROUP BY j.sim_id, j.source")
def source_soft_margin(spark, sf_dir):
    _, snap, train, _, _ = training(spark, sf_dir)
    return detect.soft_margin(train, snap).withColumn("score", F.round("score", 9))


_SWEEP = """, widths AS (SELECT k, pow(0.5::DOUBLE, k) AS a FROM (SELECT unnest(range(1, 16)) AS k)),
kern AS (SELECT sim_id, k, source, avg(exp(-pow(coalesce(j, 0) - 1, 2) / (a * a))) AS v FROM jac, widths GROUP BY sim_id, k, source, a),
norm AS (SELECT *, v / sum(v) OVER (PARTITION BY sim_id, k) AS p, sum(v) OVER (PARTITION BY sim_id, k) AS total FROM kern),
tops AS (SELECT sim_id, k, total, arg_max(source, (round(v, 12), -source)) AS m, max(v) AS best FROM norm GROUP BY sim_id, k, total),
topp AS (SELECT t.*, n.p FROM tops t LEFT JOIN norm n ON n.sim_id = t.sim_id AND n.k = t.k AND n.source = t.m),
marks AS (SELECT *, NOT coalesce(total > 0, FALSE) OR coalesce(m = lag(m) OVER w AND abs(p - lag(p) OVER w) > 0.05, FALSE) OR coalesce(lag(best) OVER w < 1e-12, FALSE) AS stop FROM topp WINDOW w AS (PARTITION BY sim_id ORDER BY k)),
pick AS (SELECT sim_id, coalesce(min(k) FILTER (WHERE stop), 16) - 1 AS k FROM marks GROUP BY sim_id)"""


@query("source_soft_margin_sweep", _TRAIN + _SOFT + _SWEEP + " SELECT n.sim_id, n.source AS node, round(ln(greatest(n.v, 1e-300::DOUBLE)), 6) AS score FROM norm n JOIN pick q ON q.sim_id = n.sim_id AND q.k = n.k JOIN snap s ON s.sim_id = n.sim_id AND s.node = n.source")
def source_soft_margin_sweep(spark, sf_dir):
    _, snap, train, _, _ = training(spark, sf_dir)
    return detect.soft_margin_sweep(train, snap).withColumn("score", F.round("score", 6))


@query("source_combined", _TRAIN + _MONTE + """, jordan AS (SELECT sim_id, node, CAST(-(far + 1000 * (n_inf - reached)) AS DOUBLE) AS c FROM per)
SELECT m.sim_id, m.node, round(m.score + 0.5 * (j.c - max(j.c) OVER (PARTITION BY m.sim_id)), 6) AS score FROM monte m JOIN jordan j ON j.sim_id = m.sim_id AND j.node = m.node""")  # fmt: skip
def source_combined(spark, sf_dir):
    edges, snap, train, sims, n = training(spark, sf_dir)
    return detect.combined(detect.monte_carlo(train, sims, snap, n), detect.jordan(edges, snap)).withColumn("score", F.round("score", 6))


_METRICS = _HOPS + """, scores AS (SELECT sim_id, node, CAST(-(total + 1000 * (n_inf - reached)) AS DOUBLE) AS score FROM per),
soft AS (SELECT s.*, exp(score - max(score) OVER (PARTITION BY sim_id)) AS e FROM scores s),
prob AS (SELECT sim_id, node, score, e / sum(e) OVER (PARTITION BY sim_id) AS prob FROM soft),
cum AS (SELECT p.*, coalesce(sum(prob) OVER (PARTITION BY sim_id ORDER BY prob DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM prob p),
mine AS (SELECT t.sim_id, t.source, s.score AS own FROM truth t LEFT JOIN scores s ON s.sim_id = t.sim_id AND s.node = t.source),
cnt AS (SELECT c.sim_id, count(*) FILTER (WHERE score > own) AS greater, count(*) FILTER (WHERE score = own) AS tied, count(*) FILTER (WHERE before < 0.9::DOUBLE - 1e-12) AS css,
        sum(pow(prob - CASE WHEN node = source THEN 1 ELSE 0 END, 2)) AS brier FROM cum c JOIN mine m ON m.sim_id = c.sim_id GROUP BY c.sim_id),
inst AS (SELECT sim_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 - greater) / tied::DOUBLE)) AS top1, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (3 - greater) / tied::DOUBLE)) AS top3,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, (5 - greater) / tied::DOUBLE)) AS top5, 1 / (greater + (tied + 1) / 2.0::DOUBLE) AS rr, css, brier FROM cnt)
"""


def instance_rows(spark, sf_dir):
    edges, runs, _, snap = epidemic(spark, sf_dir)
    return metrics.instance_metrics(detect.distance(edges, snap), runs.select("sim_id", "source"))


@query("source_metrics", _METRICS + "SELECT sim_id, round(top1, 9) AS top1, round(top3, 9) AS top3, round(top5, 9) AS top5, round(rr, 9) AS rr, css, round(brier, 9) AS brier FROM inst")
def source_metrics(spark, sf_dir):
    return instance_rows(spark, sf_dir).select("sim_id", *(F.round(c, 9).alias(c) for c in ("top1", "top3", "top5", "rr")), "css", F.round("brier", 9).alias("brier"))


@query("metric_summary", _METRICS + "SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 9) AS {c}, round(coalesce(stddev_samp({c}) / sqrt(count({c})), 0), 9) AS {c}_se" for c in ("top1", "rr", "brier")) + " FROM inst")
def metric_summary(spark, sf_dir):
    out = metrics.summary(instance_rows(spark, sf_dir), ["top1", "rr", "brier"])
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns if c != "n"))


@query("map_estimate", _METRICS + f"SELECT sim_id, node FROM (SELECT sim_id, node, row_number() OVER (PARTITION BY sim_id ORDER BY score DESC, {uniform_sql(SEED, chr(39) + 'map' + chr(39), 'sim_id', 'node')}, node) AS r FROM scores) WHERE r = 1")
def map_estimate(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return metrics.estimates(detect.distance(edges, snap), seed=SEED)


@query("error_distance", _METRICS + f""", est AS (SELECT sim_id, node FROM (SELECT sim_id, node, row_number() OVER (PARTITION BY sim_id ORDER BY score DESC, {uniform_sql(SEED, chr(39) + 'map' + chr(39), 'sim_id', 'node')}, node) AS r FROM scores) WHERE r = 1),
starts AS (SELECT sim_id, source AS node FROM truth), {hops_sql('away', 'starts', keys=('sim_id',))}
SELECT e.sim_id, coalesce(a.dist, -1) AS error_distance FROM est e LEFT JOIN away a ON a.sim_id = e.sim_id AND a.node = e.node""")  # fmt: skip
def error_distance(spark, sf_dir):
    edges, runs, _, snap = epidemic(spark, sf_dir)
    return metrics.error_distance(edges, metrics.estimates(detect.distance(edges, snap), seed=SEED), runs.select("sim_id", "source"))


# Cascades: one from each of the 12 largest hubs; every second one spreads faster.
N_CASCADES = 12
CASCADES = f"""hubs AS (SELECT node, row_number() OVER (ORDER BY deg DESC, node) - 1 AS cascade FROM deg ORDER BY deg DESC, node LIMIT {N_CASCADES}),
cascades AS (SELECT cascade, node, CASE WHEN cascade % 2 = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS kappa FROM hubs),
hits AS (SELECT c.cascade, a.src, a.dst FROM cascades c, arcs a WHERE {uniform_sql(SEED, 'c.cascade', 'a.src', 'a.dst')} < least(1.0::DOUBLE, c.kappa * a.p)),
{hops_sql('act', 'cascades', 'hits', ('cascade',), 'round')}"""
GRID = sequential.factor_grid(1.5, 6.0, 0.6)


def running_cascades(spark, sf_dir):
    """arcs, cascades, activations"""
    edges = edges_of(spark, sf_dir)
    arcs = kept(diffusion.edge_probabilities(edges, "wc"))
    order = W.orderBy(F.col("deg").desc(), "node")
    hubs = graph.top(graph.degrees(edges), N_CASCADES, F.col("deg").desc(), F.col("node")).withColumn("cascade", (F.row_number().over(order) - 1).cast("long"))
    cascades = checkpoint(hubs.select("cascade", "node", F.when(F.col("cascade") % 2 == 1, 3.0).otherwise(1.0).alias("kappa")))
    return arcs, cascades, checkpoint(diffusion.episodes(arcs, cascades, seed=SEED, max_rounds=None))


@query("episodes", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES} SELECT cascade, node, round FROM act")
def episodes(spark, sf_dir):
    return running_cascades(spark, sf_dir)[2]


@query("cascade_growth", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, g AS (SELECT cascade, round, count(*) AS new FROM act GROUP BY cascade, round) SELECT cascade, round, new, CAST(sum(new) OVER (PARTITION BY cascade ORDER BY round) AS BIGINT) AS size FROM g")
def cascade_growth(spark, sf_dir):
    return sequential.growth(running_cascades(spark, sf_dir)[2])


_FACTORS = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate([1.0, *GRID]))
EXPOSURE = f"""met AS (SELECT a.cascade, a.round + 1 AS round, r.dst AS node, r.p, h.round AS hit_round FROM act a JOIN arcs r ON r.src = a.node LEFT JOIN act h ON h.cascade = a.cascade AND h.node = r.dst
  WHERE h.round IS NULL OR h.round >= a.round + 1),
factors AS (SELECT * FROM (VALUES {_FACTORS}) v(k_idx, factor)),
exposure AS (SELECT cascade, round, node, k_idx, sum(ln(1 - least(0.999999999999::DOUBLE, least(1.0::DOUBLE, factor * p)))) AS log1mq, max(CASE WHEN hit_round = round THEN 1 ELSE 0 END) AS outcome
  FROM met, factors GROUP BY cascade, round, node, k_idx),
q AS (SELECT *, ln(greatest(1e-300::DOUBLE, 1 - exp(log1mq))) AS hit FROM exposure),
ev AS (SELECT a.cascade, a.round, a.k_idx, sum(CASE WHEN a.outcome = 1 THEN a.hit - b.hit ELSE a.log1mq - b.log1mq END) AS llr
  FROM q a JOIN q b ON b.cascade = a.cascade AND b.round = a.round AND b.node = a.node AND b.k_idx = 0 WHERE a.k_idx > 0 GROUP BY a.cascade, a.round, a.k_idx)"""
_SEQ = f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, {EXPOSURE}"


def evidence_of(spark, sf_dir):
    """arcs, cascades, activations, exposure, evidence"""
    arcs, cascades, act = running_cascades(spark, sf_dir)
    return arcs, cascades, act, sequential.exposures(arcs, act, GRID), sequential.evidence(arcs, act, GRID)


@query("exposure", f"{_SEQ} SELECT cascade, round, node, k_idx, round(log1mq, 6) AS log1mq, outcome FROM exposure")
def exposure(spark, sf_dir):
    return evidence_of(spark, sf_dir)[3].withColumn("log1mq", F.round("log1mq", 6))


@query("round_evidence", f"{_SEQ} SELECT cascade, round, k_idx, round(llr, 4) AS llr FROM ev")
def round_evidence(spark, sf_dir):
    return evidence_of(spark, sf_dir)[4].withColumn("llr", F.round("llr", 4))


_TOTAL = f"total AS (SELECT cascade, round, k_idx, sum(llr) OVER (PARTITION BY cascade, k_idx ORDER BY round) AS l FROM ev)"
_FACTOR_OF = "(SELECT factor FROM factors f WHERE f.k_idx = t.k_idx)"
_EPROC = f"""{_TOTAL}, tops AS (SELECT t.*, max(l) OVER (PARTITION BY cascade, round) AS m, f.factor FROM total t JOIN factors f ON f.k_idx = t.k_idx),
ep AS (SELECT cascade, round, max(m) + ln(sum(exp(l - m))) - ln({len(GRID)}) AS log_e, sum(exp(l - m) * factor) / sum(exp(l - m)) AS kappa_hat FROM tops GROUP BY cascade, round)"""


def eprocess_of(spark, sf_dir):
    return sequential.eprocess(evidence_of(spark, sf_dir)[4], len(GRID), GRID)


@query("eprocess", f"{_SEQ}, {_EPROC} SELECT cascade, round, round(log_e, 4) AS log_e, round(kappa_hat, 4) AS kappa_hat FROM ep")
def eprocess(spark, sf_dir):
    return eprocess_of(spark, sf_dir).select("cascade", "round", F.round("log_e", 4).alias("log_e"), F.round("kappa_hat", 4).alias("kappa_hat"))


@query("eprocess_alarm", f"{_SEQ}, {_EPROC} SELECT cascade, min(round) AS alarm_round FROM ep WHERE log_e >= ln(5) GROUP BY cascade")
def eprocess_alarm(spark, sf_dir):
    return sequential.alarms(eprocess_of(spark, sf_dir), "log_e", math.log(5))


@query("sprt", f"{_SEQ}, {_TOTAL} SELECT cascade, round, round(l, 4) AS statistic FROM total WHERE k_idx = 2")
def sprt(spark, sf_dir):
    return sequential.sprt(evidence_of(spark, sf_dir)[4], 2).withColumn("statistic", F.round("statistic", 4))


@query("cusum", f"{_SEQ}, {_TOTAL} SELECT cascade, round, round(l - least(0, min(l) OVER (PARTITION BY cascade ORDER BY round)), 4) AS statistic FROM total WHERE k_idx = 2")
def cusum(spark, sf_dir):
    return sequential.cusum(evidence_of(spark, sf_dir)[4], 2).withColumn("statistic", F.round("statistic", 4))


@query("excess", f"{_SEQ}, x AS (SELECT cascade, round, sum(outcome) AS o, sum(1 - exp(log1mq)) AS e FROM exposure WHERE k_idx = 0 GROUP BY cascade, round), c AS (SELECT cascade, round, sum(o) OVER w AS o, sum(e) OVER w AS e FROM x WINDOW w AS (PARTITION BY cascade ORDER BY round)) SELECT cascade, round, round((o - e) / sqrt(greatest(e, 1.0::DOUBLE)), 6) AS statistic FROM c")
def excess(spark, sf_dir):
    return sequential.excess(evidence_of(spark, sf_dir)[3]).withColumn("statistic", F.round("statistic", 6))


@query("size_threshold", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, g AS (SELECT cascade, round, count(*) AS new FROM act GROUP BY cascade, round), z AS (SELECT cascade, sum(new) AS v FROM g GROUP BY cascade), r AS (SELECT v, row_number() OVER (ORDER BY v, cascade) AS r, count(*) OVER () AS m FROM z) SELECT CAST(v AS BIGINT) AS threshold FROM r WHERE r = least(m, ceil((m + 1) * 0.9::DOUBLE))")
def size_threshold(spark, sf_dir):
    return sequential.calibrated_threshold(sequential.growth(running_cascades(spark, sf_dir)[2]), "size", 0.1)


_FRONT = "last AS (SELECT cascade, max(round) AS r FROM act GROUP BY cascade), front AS (SELECT a.cascade, a.node FROM act a JOIN last l ON l.cascade = a.cascade WHERE a.round = l.r)"
_MASS = f"""{_FRONT}, om AS (SELECT src AS node, sum(p) AS out_mass FROM arcs GROUP BY src),
mass AS (SELECT f.cascade, r.dst AS node, least(1.0::DOUBLE, sum(r.p)) AS mass FROM front f JOIN arcs r ON r.src = f.node WHERE NOT EXISTS (SELECT 1 FROM front g WHERE g.cascade = f.cascade AND g.node = r.dst) GROUP BY f.cascade, r.dst),
mw AS (SELECT m.cascade, m.node, m.mass, 1 + coalesce(o.out_mass, 0) AS weight FROM mass m LEFT JOIN om o ON o.node = m.node)"""


def frontier_of(act: DataFrame) -> DataFrame:
    last = act.groupBy("cascade").agg(F.max("round").alias("round"))
    return act.join(last, ["cascade", "round"], "left_semi").select("cascade", "node")


@query("exposure_mass", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, {_MASS} SELECT cascade, node, round(mass, 9) AS mass, round(weight, 9) AS weight FROM mw")
def exposure_mass(spark, sf_dir):
    arcs, _, act = running_cascades(spark, sf_dir)
    return sequential.exposure_mass(arcs, frontier_of(act)).select("cascade", "node", F.round("mass", 9).alias("mass"), F.round("weight", 9).alias("weight"))


@query("hub_throttle", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, {_MASS}, rnd AS (SELECT cascade, node, CAST(round(mass * 1e6) AS BIGINT) AS mass, CAST(round(weight * 1e6) AS BIGINT) AS weight FROM mw), o AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY cascade ORDER BY weight DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(mass) OVER (PARTITION BY cascade) AS t FROM rnd) SELECT cascade, node FROM o WHERE b < 0.5::DOUBLE * t")
def hub_throttle(spark, sf_dir):
    arcs, _, act = running_cascades(spark, sf_dir)
    rows = sequential.exposure_mass(arcs, frontier_of(act)).select("cascade", "node", *(F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("mass", "weight")))
    return sequential.throttle_by_weight(rows, 0.5)


_ROWS = "rnd AS (SELECT cascade, node, CAST(round(mass * 1e6) AS BIGINT) AS mass, CAST(round(weight * 1e6) AS BIGINT) AS weight FROM mw)"


def throttle_rows(spark, sf_dir):
    """Nodes at risk of the running cascades: cascade, node, mass and weight in millionths."""
    arcs, _, act = running_cascades(spark, sf_dir)
    return sequential.exposure_mass(arcs, frontier_of(act)).select("cascade", "node", *(F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("mass", "weight")))


@query("random_throttle", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, {_MASS}, {_ROWS}, o AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY cascade ORDER BY {uniform_sql(SEED, chr(39) + 'throttle' + chr(39), 'cascade', 'node')} DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(mass) OVER (PARTITION BY cascade) AS t FROM rnd) SELECT cascade, node FROM o WHERE b < 0.5::DOUBLE * t")
def random_throttle(spark, sf_dir):
    return sequential.throttle_at_random(throttle_rows(spark, sf_dir), 0.5, seed=SEED)


@query("gated_throttle", f"{_SEQ}, {_EPROC}, {_MASS}, lastly AS (SELECT cascade, arg_max(round(log_e, 4), round) AS le FROM ep GROUP BY cascade) SELECT m.cascade, m.node, 0.3::DOUBLE AS rho FROM mw m JOIN lastly l ON l.cascade = m.cascade WHERE l.le >= ln(2)")
def gated_throttle(spark, sf_dir):
    """All nodes at risk of the cascades whose evidence has passed a soft threshold, slowed down to 0.3."""
    arcs, _, act, _, evidence = evidence_of(spark, sf_dir)
    statistic = sequential.eprocess(evidence, len(GRID), GRID).withColumn("log_e", F.round("log_e", 4))
    rows = sequential.exposure_mass(arcs, frontier_of(act))
    return sequential.throttle_uniform(sequential.gated(rows, statistic, "log_e", 0.5), 0.3)


_HARM = f"""{_FRONT}, lastly AS (SELECT cascade, arg_max(round(kappa_hat, 4), round) AS kappa_hat, max(round(log_e, 4)) AS le FROM ep GROUP BY cascade),
harm AS (SELECT f.cascade, sum(least(1.0::DOUBLE, k.kappa_hat * a.p)) AS h FROM front f JOIN lastly k ON k.cascade = f.cascade JOIN arcs a ON a.src = f.node WHERE NOT EXISTS (SELECT 1 FROM act x WHERE x.cascade = f.cascade AND x.node = a.dst) GROUP BY f.cascade)"""


@query("weighted_e_bh", f"{_SEQ}, {_EPROC}, {_HARM}, e AS (SELECT l.cascade, exp(l.le) AS e, round(coalesce(h.h, 0), 6) + 1e-9::DOUBLE AS w FROM lastly l LEFT JOIN harm h ON h.cascade = l.cascade), n AS (SELECT cascade, e * w / avg(w) OVER () AS we FROM e), r AS (SELECT cascade, we, row_number() OVER (ORDER BY we DESC, cascade) AS k, count(*) OVER () AS m FROM n), z AS (SELECT *, max(CASE WHEN we >= m / (k * 0.5::DOUBLE) THEN k END) OVER () AS most FROM r) SELECT cascade, k FROM z WHERE k <= most")
def weighted_e_bh(spark, sf_dir):
    """e-BH over the running cascades, weighted by what their frontiers may still reach."""
    arcs, _, act, _, evidence = evidence_of(spark, sf_dir)
    process = checkpoint(sequential.eprocess(evidence, len(GRID), GRID))
    latest = process.groupBy("cascade").agg(F.max_by(F.round("kappa_hat", 4), "round").alias("kappa_hat"), F.exp(F.max(F.round("log_e", 4))).alias("e"))
    harm = sequential.frontier_harm(arcs, frontier_of(act), act, latest).withColumn("w", F.round("harm", 6) + 1e-9)
    rows = latest.join(harm, "cascade", "left").na.fill({"w": 1e-9})
    return sequential.e_benjamini_hochberg(rows, 0.5, weight="w").select("cascade", "k")


@query("e_bh", f"{_SEQ}, {_EPROC}, e AS (SELECT cascade, max(round(log_e, 4)) AS le FROM ep GROUP BY cascade), r AS (SELECT cascade, le, row_number() OVER (ORDER BY le DESC, cascade) AS k, count(*) OVER () AS m FROM e), z AS (SELECT *, max(CASE WHEN exp(le) >= m / (k * 0.5::DOUBLE) THEN k END) OVER () AS most FROM r) SELECT cascade, k FROM z WHERE k <= most")
def e_bh(spark, sf_dir):
    best = eprocess_of(spark, sf_dir).groupBy("cascade").agg(F.max(F.round("log_e", 4)).alias("log_e")).withColumn("e", F.exp("log_e"))
    return sequential.e_benjamini_hochberg(best, 0.5).select("cascade", "k")


@query("detection_summary", f"""{_SEQ}, {_EPROC}, alarm AS (SELECT cascade, min(round) AS alarm_round FROM ep WHERE log_e >= ln(5) GROUP BY cascade),
fin AS (SELECT cascade, count(*) AS h FROM act GROUP BY cascade), at_alarm AS (SELECT a.cascade, count(*) AS h FROM act a JOIN alarm m ON m.cascade = a.cascade WHERE a.round <= m.alarm_round GROUP BY a.cascade),
eps AS (SELECT c.cascade, c.kappa > 1 AS harmful, m.alarm_round, t.h AS at_alarm, coalesce(t.h, f.h) AS final, f.h AS counter FROM cascades c JOIN fin f ON f.cascade = c.cascade LEFT JOIN alarm m ON m.cascade = c.cascade LEFT JOIN at_alarm t ON t.cascade = c.cascade)
SELECT round(avg(CASE WHEN NOT harmful THEN CASE WHEN alarm_round IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS false_alarms, round(avg(CASE WHEN harmful THEN CASE WHEN alarm_round IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS detected,
       round(avg(CASE WHEN harmful THEN alarm_round END), 6) AS delay, round(1 - sum(CASE WHEN harmful THEN final END) / sum(CASE WHEN harmful THEN counter END)::DOUBLE, 6) AS saved FROM eps""")  # fmt: skip
def detection_summary(spark, sf_dir):
    arcs, cascades, act, _, ev = evidence_of(spark, sf_dir)
    alarm = checkpoint(sequential.alarms(sequential.eprocess(ev, len(GRID), GRID), "log_e", math.log(5)))
    at = sequential.harm_at_alarm(arcs, act, alarm, cascades.select("cascade", "kappa")).select("cascade", F.col("harm").alias("harm_at_alarm"))
    end = act.groupBy("cascade").agg(F.count("*").alias("harm_counterfactual"))
    eps = cascades.join(end, "cascade").join(alarm, "cascade", "left").join(at, "cascade", "left")
    eps = eps.select((F.col("kappa") > 1).alias("harmful"), "alarm_round", "harm_at_alarm", F.coalesce("harm_at_alarm", "harm_counterfactual").alias("harm_final"), "harm_counterfactual")
    return metrics.detection_summary(eps).select(*(F.round(c, 6).alias(c) for c in ("false_alarms", "detected", "delay", "saved")))


@query("early_features", f"WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, g AS (SELECT cascade, round, count(*) AS new FROM act WHERE round <= 3 GROUP BY cascade, round) SELECT cascade, CAST(sum(new) AS BIGINT) AS size, max(round) AS rounds, avg(new) AS mean_new, max(new) AS max_new, arg_max(new, round) AS last_new FROM g GROUP BY cascade")
def early_features(spark, sf_dir):
    return sequential.features(running_cascades(spark, sf_dir)[2], 3)


@query("logistic_early")
def logistic_early(spark, sf_dir):
    _, cascades, act = running_cascades(spark, sf_dir)
    rows = sequential.features(act, 3).join(cascades.select("cascade", (F.col("kappa") > 1).alias("harmful")), "cascade")
    posterior = sequential.fit_logistic(rows, ["size", "rounds", "mean_new", "max_new", "last_new"])
    return rows.select("cascade", "harmful", F.round(posterior, 6).alias("posterior"))


@query("commit_exposed", f"""WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, early AS (SELECT cascade, node, round FROM act WHERE round <= 1),
risk AS (SELECT f.cascade, a.dst AS node, 1 - exp(sum(ln(1 - least(0.999999999999::DOUBLE, a.p)))) AS q FROM early f JOIN arcs a ON a.src = f.node WHERE f.round = 1 AND NOT EXISTS (SELECT 1 FROM early e WHERE e.cascade = f.cascade AND e.node = a.dst) GROUP BY f.cascade, a.dst),
wide AS (SELECT r.cascade, r.node, r.q, (SELECT count(*) FROM arcs a WHERE a.src = r.node AND NOT EXISTS (SELECT 1 FROM early e WHERE e.cascade = r.cascade AND e.node = a.dst)) AS c FROM risk r)
SELECT cascade, node, round(q, 9) AS q, c FROM wide WHERE q * (c + 1) >= 1 - 1e-9::DOUBLE""")  # fmt: skip
def commit_exposed(spark, sf_dir):
    arcs, _, act = running_cascades(spark, sf_dir)
    early = act.where("round <= 1")
    front = early.where("round = 1").select("cascade", "node")
    near = front.withColumnRenamed("node", "src").join(arcs, "src").select("cascade", F.col("dst").alias("node")).distinct().join(early, ["cascade", "node"], "left_anti")
    return sequential.commit_exposed(arcs, front, near, early, 1.0).withColumn("q", F.round("q", 9))


@query("competing_campaigns")
def competing_campaigns(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    arcs, start = kept(diffusion.edge_probabilities(edges, "wc")), checkpoint(hub(edges))
    good = checkpoint(blocking.degree_blocker(edges, start, 3).select("node"))
    live = checkpoint(diffusion.worlds_from(arcs, start.union(good), 8, seed=SEED)[1])
    out = diffusion.competing(live, start, good, 8, delay=1)
    return out.groupBy("sample", "campaign").agg(F.count("*").alias("n"), F.max("round").alias("rounds"))


@query("exact_spread", """WITH lines AS (SELECT l_orderkey, l_suppkey, 1.0 - exp(sum(ln(1.0 - l_quantity / 100.0::DOUBLE))) AS q FROM lineitem GROUP BY l_orderkey, l_suppkey)
SELECT l_orderkey AS graph_id, round(sum(q), 9) AS spread FROM lines GROUP BY l_orderkey""")  # fmt: skip
def exact_spread(spark, sf_dir):
    """Exact spread from each order over its lines, which lead to suppliers: a small graph for each order, lines of one supplier being parallel arcs."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct((-F.col("l_orderkey")).alias("u"), F.col("l_suppkey").alias("v"), (F.col("l_quantity") / 100.0).alias("p")).alias("e"))
    packed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    graphs_of = packed.select(F.col("l_orderkey").alias("graph_id"), "edges", F.array(-F.col("l_orderkey")).alias("seeds"), F.array().cast("array<bigint>").alias("blocked"))
    return blocking.exact_spread(graphs_of).withColumn("spread", F.round("spread", 9))


# Reports over the star schema: the relational shapes of run records.
@query("latest_run", "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_run(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_o", F.struct("ts", "event_id"))
    return metrics.latest(rows, ["user_id", "event_type"], "_o").select("user_id", "event_type", "value")


@query("paired_difference", "WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id), d AS (SELECT a.v - b.v AS d FROM a JOIN b ON a.user_id = b.user_id) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(CASE WHEN d < 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 6) AS win_rate FROM d")
def paired_difference(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.agg(F.min("event_type"), F.max("event_type")).first()
    rows = events.where(F.col("event_type").isin(*ends)).groupBy("user_id", F.col("event_type").alias("method")).agg(F.avg("value").alias("value"))
    return metrics.paired_difference(rows, ends[0], ends[1], "value", ["user_id"]).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "se", "win_rate")))


@query("typical_value", "SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (WHERE value IS NOT NULL) AS n FROM events GROUP BY event_type")
def typical_value(spark, sf_dir):
    return metrics.typical(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "n")


@query("line_fit", "SELECT l_returnflag, round(covar_samp(l_extendedprice, l_quantity), 3) AS cov, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY l_returnflag")
def line_fit(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return metrics.line_fit(rows, ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", F.round("cov", 3).alias("cov"), F.round("slope", 6).alias("slope"))


@query("pivot_by_status", "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_by_status(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = metrics.pivoted(rows, ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity")
    return out.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("hash_uniforms", f"SELECT o_orderkey, {uniform_sql(SEED, 'o_orderkey', 'o_custkey')} AS u FROM orders")
def hash_uniforms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", uniform(SEED, "o_orderkey", "o_custkey").alias("u"))


# Containment: cascades are stopped by plans made when their alarm fires.
def alarmed(spark, sf_dir):
    """edges, arcs, cascades, activations, alarms by size, state at the alarm"""
    arcs, cascades, act = running_cascades(spark, sf_dir)
    alarms = checkpoint(sequential.alarms(sequential.growth(act), "size", 3))
    return arcs, cascades, act, alarms, checkpoint(containment.state_at(act, alarms))


_ALARMED = f"""WITH RECURSIVE {EDGES}, {WC}, {CASCADES}, g AS (SELECT cascade, round, count(*) AS new FROM act GROUP BY cascade, round),
s AS (SELECT cascade, round, sum(new) OVER (PARTITION BY cascade ORDER BY round) AS size FROM g), alarm AS (SELECT cascade, min(round) AS alarm_round FROM s WHERE size >= 3 GROUP BY cascade),
pre AS (SELECT a.cascade, a.node, a.round, m.alarm_round FROM act a JOIN alarm m ON m.cascade = a.cascade WHERE a.round <= m.alarm_round),
state AS (SELECT cascade, node, round = max(round) OVER (PARTITION BY cascade) AS front FROM pre)"""


@query("state_at_alarm", _ALARMED + " SELECT cascade, node, front FROM state")
def state_at_alarm(spark, sf_dir):
    return alarmed(spark, sf_dir)[4]


@query("contain_degree", _ALARMED + """ SELECT cascade, node, rank FROM (SELECT c.cascade, d.node, row_number() OVER (PARTITION BY c.cascade ORDER BY d.deg DESC, d.node) AS rank
FROM (SELECT DISTINCT cascade FROM state) c, deg d WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.cascade = c.cascade AND s.node = d.node)) WHERE rank <= 5""")  # fmt: skip
def contain_degree(spark, sf_dir):
    return containment.degree_plan(edges_of(spark, sf_dir), alarmed(spark, sf_dir)[4], 5)


@query("contain_proximity", _ALARMED + """, fronts AS (SELECT cascade, node FROM state WHERE front), """ + hops_sql("near", "fronts", keys=("cascade",)) + """
SELECT cascade, node, rank FROM (SELECT n.cascade, n.node, row_number() OVER (PARTITION BY n.cascade ORDER BY n.dist, d.deg DESC, n.node) AS rank FROM near n JOIN deg d ON d.node = n.node
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.cascade = n.cascade AND s.node = n.node)) WHERE rank <= 5""")  # fmt: skip
def contain_proximity(spark, sf_dir):
    return containment.proximity_plan(edges_of(spark, sf_dir), alarmed(spark, sf_dir)[4], 5)


@query("contain_dominator")
def contain_dominator(spark, sf_dir):
    """Harm with and without the plans of the dominator planner, by cascade."""
    arcs, cascades, act, alarms, state = alarmed(spark, sf_dir)
    plan = checkpoint(containment.dominator_plan(arcs, state, cascades.select("cascade", "kappa"), 4, samples=8))
    after = containment.contained(arcs, cascades, alarms, plan, seed=SEED, max_rounds=None)
    count = lambda rows, name: rows.groupBy("cascade").agg(F.count("*").alias(name))
    return count(act, "harm_counterfactual").join(count(after, "harm_final"), "cascade")


@query("source_message_passing")
def source_message_passing(spark, sf_dir):
    edges, _, _, snap = epidemic(spark, sf_dir)
    return message_passing(edges, snap, beta=BETA, horizon=HORIZON).withColumn("score", F.round("score", 6))
