"""Planners, detectors and numbering against brute force on small graphs."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.operators import blocking, containment, detect, metrics, sequential
from diffspark.operators.message_passing import candidate_scores, message_passing
from diffspark.sources import graphs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def graph_of(spark, pairs):
    return graphs.both_ways(spark.createDataFrame(pairs, "src long, dst long"))


PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (5, 6), (4, 6), (6, 7)]
INFECTED = [0, 1, 2, 3, 4, 5, 6]


def neighbours(pairs, among):
    near = {v: set() for v in among}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    return near


def all_shortest_paths(near, a, b):
    paths, found = [[a]], []
    while paths and not found:
        found = [p for p in paths if p[-1] == b]
        paths = [[*p, v] for p in paths for v in near[p[-1]] if v not in p]
    return found


def snapshot(spark, nodes):
    return spark.createDataFrame([(1, v, 1 + v % 2) for v in nodes], "sim_id long, node long, state int")


def test_betweenness_counts_shortest_paths(spark):
    near = neighbours(PAIRS, INFECTED)
    n = len(INFECTED)
    want = {}
    for v in INFECTED:
        total = 0.0
        for a, b in itertools.permutations([x for x in INFECTED if x != v], 2):
            paths = all_shortest_paths(near, a, b)
            total += sum(v in p for p in paths) / len(paths)
        want[v] = total / ((n - 1) * (n - 2))
    got = dict(rows(detect.betweenness(graph_of(spark, PAIRS), snapshot(spark, INFECTED)), "node", "score"))
    assert got == pytest.approx(want)


def test_rumor_counts_orders_on_a_tree(spark):
    tree = [(0, 1), (1, 2), (1, 3), (3, 4)]
    near = neighbours(tree, range(5))
    want = {}
    for root in range(5):  # orders in which the tree can grow from the root
        want[root] = math.log(sum(all(any(u in near[v] for u in p[:i]) for i, v in enumerate(p) if i) for p in itertools.permutations(range(5)) if p[0] == root))
    got = dict(rows(detect.rumor(graph_of(spark, tree), snapshot(spark, range(5))), "node", "score"))
    assert got == pytest.approx(want)


def test_netsleuth_is_the_smallest_eigenvector(spark):
    full = neighbours(PAIRS, range(8))
    m = np.zeros((len(INFECTED), len(INFECTED)))
    for v in INFECTED:
        m[v, v] = len(full[v])
        for u in full[v]:
            if u in INFECTED:
                m[v, u] = -1
    v = np.ones(len(INFECTED))
    for _ in range(5000):  # power iteration on the shifted matrix
        v = 20 * v - m @ v
        v /= np.linalg.norm(v)
    got = dict(rows(detect.netsleuth(graph_of(spark, PAIRS), snapshot(spark, INFECTED)), "node", "score"))
    assert [got[k] for k in INFECTED] == pytest.approx(np.abs(v).tolist(), abs=1e-6)


def test_message_passing_on_one_arc(spark):
    """Two nodes: the chances of each state follow in closed form from the recursion over a single arc."""
    beta, horizon, dt = 0.8, 0.3, 0.1
    lam, mu = 1 - math.exp(-beta * dt), 1 - math.exp(-dt)
    theta, phi, p_i, p_r = 1.0, 1.0, 1.0, 0.0
    for _ in range(3):
        theta -= lam * phi
        phi *= (1 - lam) * (1 - mu)
        p_r, p_i = p_r + mu * p_i, p_i - mu * p_i
    other_s, other_r, other_i = 1.0, 0.0, 0.0
    theta2, phi2 = 1.0, 1.0
    for _ in range(3):
        theta2 -= lam * phi2
        phi2 *= (1 - lam) * (1 - mu)
        other_r += mu * other_i
        other_s = theta2
        other_i = 1 - other_s - other_r
    snap = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "sim_id long, node long, state int")
    got = dict(rows(message_passing(graph_of(spark, [(0, 1)]), snap, beta=beta, horizon=horizon, dt=dt), "node", "score"))
    assert got == pytest.approx(dict.fromkeys((0, 1), math.log(p_i) + math.log(other_i)))


def test_message_passing_memory_does_not_grow_with_candidates():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 400, (4000, 2)), axis=0)
    pairs = np.unique(np.vstack([pairs, pairs[:, ::-1]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    _, ends = np.unique(pairs, return_inverse=True)
    src, dst = ends.reshape(pairs.shape).T
    seen = (np.arange(src.max() + 1) % 2).astype(int)
    peaks, scores = [], []
    for cells in (len(src), len(src) * len(seen)):
        tracemalloc.start()
        scores.append(candidate_scores(src, dst, seen, lam=0.1, mu=0.1, steps=3, cells=cells)[1])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert scores[0] == pytest.approx(scores[1]) and len(scores[0]) == 200
    assert peaks[0] < 20 * 8 * len(src) and peaks[1] > 20 * peaks[0]


def test_cost_aware_plan_sees_a_cut(spark):
    # The seed reaches 12 nodes over two ways: no single node saves more than itself, both ways together save all.
    live = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 2, 3), *((0, 3, k) for k in range(4, 12))], "sample int, src long, dst long")
    arcs = live.select("src", "dst", F.lit(1.0).alias("p"))
    seeds = spark.createDataFrame([(0,)], "node long")
    assert rows(blocking.cost_aware_plan(live, seeds, arcs, 1), "move", "node", "ratio") == [(1, 3, 9.0)]
    hidden = spark.createDataFrame([(0, 0, 1), (0, 0, 2), *((0, a, k) for a in (1, 2) for k in range(4, 12))], "sample int, src long, dst long")
    got = rows(blocking.cost_aware_plan(hidden, seeds, hidden.select("src", "dst", F.lit(1.0).alias("p")), 2), "move", "node", "ratio")
    assert got == [(1, 1, 5.0), (1, 2, 5.0)]


def test_control_variate_gains_without_chance(spark):
    """Where every arc is live in every world, the event's chance is 1, its variance 0, and the means stay."""
    live = spark.createDataFrame([(s, 0, 1) for s in range(4)] + [(s, 1, 2) for s in range(4)], "sample int, src long, dst long")
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, p double")
    got = rows(blocking.control_variate_gains(live, spark.createDataFrame([(0,)], "node long"), arcs, 4), "node", "gain")
    assert got == [(1, pytest.approx(2.0)), (2, pytest.approx(1.0))]


def test_cross_validated_pick(spark):
    gains = spark.createDataFrame([(0, 1, 9), (1, 1, 9), (2, 1, 1), (3, 1, 1), (0, 2, 5), (1, 2, 5), (2, 2, 5), (3, 2, 5), (2, 3, 50)], "sample int, node long, gain long")
    assert rows(blocking.cross_validated(2)(gains, 4), "node", "gain") == [(1, 2.0), (2, 10.0)]


def test_pick_of_no_score_is_a_pick(spark):
    live = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (1, 2, 3)], "sample int, src long, dst long")
    assert rows(blocking.scored_pick(live, spark.createDataFrame([(0,)], "node long"), 2, blocking.cross_validated(1)), "rank", "node", "gain") == [(1, 1, 0.0)]


def test_degree_plan_takes_the_largest_inactive(spark):
    rng = random.Random(4)
    pairs = list({tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)})
    edges, deg = graph_of(spark, pairs), {}
    for a, b in pairs:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    active = {c: set(rng.sample(sorted(deg), rng.randint(1, 15))) for c in range(6)} | {9: set(sorted(deg)[:-2])}
    state = spark.createDataFrame([(c, v, True) for c, vs in active.items() for v in vs], "cascade long, node long, front boolean")
    want = sorted((c, v, i + 1) for c, vs in active.items() for i, v in enumerate(sorted((v for v in deg if v not in vs), key=lambda v: (-deg[v], v))[:4]))
    assert rows(containment.degree_plan(edges, state, 4), "cascade", "node", "rank") == want


def test_numbered(spark):
    data = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10_000), 500)], "x long").repartition(7)
    got = rows(graphs.numbered(data, F.col("x").desc()), "number", "x")
    assert [n for n, _ in got] == list(range(500)) and [x for _, x in got] == sorted((x for _, x in got), reverse=True)
    assert graphs.numbered(data.limit(0), "x").isEmpty()


@pytest.mark.parametrize(("p", "low", "high"), [(0.0, 0, 0), (0.3, 450, 660), (1.0, 1830 - 60, 1770)])
def test_erdos_renyi_of_any_density(spark, p, low, high):
    m = graphs.erdos_renyi(spark, 60, p, 5).count() / 2
    assert low <= m <= high


def test_error_distance_and_saved_fraction(spark):
    edges = graph_of(spark, [(0, 1), (1, 2), (5, 6)])
    estimates = spark.createDataFrame([(1, 2), (2, 5), (3, 0)], "sim_id long, node long")
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "sim_id long, source long")
    assert rows(metrics.error_distance(edges, estimates, truth), "sim_id", "error_distance") == [(1, 2), (2, -1), (3, 0)]
    live = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1)], "sample int, src long, dst long")
    ranking = spark.createDataFrame([(2, 1), (1, 2)], "node long, rank int")
    got = metrics.saved_fraction(live, spark.createDataFrame([(0,)], "node long"), 2, ranking, [1, 2], 4)
    assert rows(got, "budget", "base", "after", "saved_frac") == [(1, 2.5, 2.0, pytest.approx(0.2)), (2, 2.5, 1.0, pytest.approx(0.6))]


def test_throttles_and_gate(spark):
    r = spark.createDataFrame([(c, v, 1.0, 0.5) for c in (1, 2) for v in range(4)], "cascade long, node long, weight double, mass double")
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.1), (2, 1, 0.0), (2, 2, 1.0)], "cascade long, round int, log_e double")
    assert {c for c, _ in rows(sequential.gated(r, s, "log_e", 0.5), "cascade", "node")} == {2}
    assert sequential.gated(r, s, "log_e", 1.0).count() == 8
    assert rows(sequential.throttle_uniform(r, 0.3).where("cascade = 1"), "node", "rho") == [(v, 0.3) for v in range(4)]
    assert sequential.throttle_at_random(r, 0.5).groupBy("cascade").count().where("count = 2").count() == 2


def test_sweep_keeps_a_stable_width(spark):
    snap = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "sim_id long, node long, state int")
    train = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (2, 20, 2), (2, 20, 3), (2, 20, 4)], "source long, sim long, node long")
    got = dict(rows(detect.soft_margin_sweep(train, snap), "node", "score"))
    kernel = lambda j, k: math.exp(-((j - 1) ** 2) * 4**k)
    share, width = 0.0, 0
    for k in range(1, 16):
        v = (kernel(1.0, k), kernel(0.25, k))
        p = v[0] / sum(v)
        if k > 1 and abs(p - share) > 0.05:
            break
        share, width = p, k
    assert got == pytest.approx({1: 0.0, 2: math.log(kernel(0.25, width))})
