"""Dominator trees, lazy and racing planners against removal, one node after another."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from diffspark.operators import blocking, containment, diffusion, lazy
from diffspark.operators.dominators import ancestors, dominators, plans
from diffspark.sources import graphs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def worlds(rng, samples, n, p):
    return {s: [(u, v) for u, v in itertools.permutations(range(n), 2) if rng.random() < p] for s in range(samples)}


def table(spark, arcs):
    return spark.createDataFrame([(s, u, v) for s, own in arcs.items() for u, v in own], "sample int, src long, dst long")


def reached(arcs, seeds, without=()):
    seen, stack = set(), [s for s in seeds if s not in without]
    while stack:
        u = stack.pop()
        if u not in seen and u not in without:
            seen.add(u)
            stack += [b for a, b in arcs if a == u]
    return seen


def brute_gains(arcs, seeds, blocked=()):
    out = {}
    for s, own in arcs.items():
        whole = reached(own, seeds, blocked)
        for v in whole - set(seeds):
            out[s, v] = len(whole) - len(reached(own, seeds, (*blocked, v)))
    return out


def brute_greedy(arcs, seeds, k):
    plan = []
    for rank in range(1, k + 1):
        total = {}
        for (_, v), g in brute_gains(arcs, seeds, tuple(p[1] for p in plan)).items():
            total[v] = total.get(v, 0) + g
        if not total:
            break
        best = min(total, key=lambda v: (-total[v], v))
        plan.append((rank, best, total[best]))
    return plan


@pytest.mark.parametrize("most_arcs", [200_000, 0])
def test_dominators_equal_what_removal_loses(spark, most_arcs):
    """By kernels of small worlds and by joins alike."""
    rng = random.Random(5)
    arcs = worlds(rng, 40, 9, 0.16) | {100: [(k, k + 1) for k in range(12)], 101: [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 1)], 102: [(5, 6)]}
    for seeds in ([0], [0, 3]):
        starts = spark.createDataFrame([(s,) for s in seeds], "node long")
        tree = dominators(table(spark, arcs), starts, keys=["sample"], most_arcs=most_arcs).collect()
        assert {(r["sample"], r["node"]) for r in tree} == {(s, v) for s, own in arcs.items() if own for v in reached(own, seeds)}
        assert {(r["sample"], r["node"]): r["size"] for r in tree if not r["seed"]} == brute_gains(arcs, seeds)
        by = {(r["sample"], r["node"]): r for r in tree}
        for r in tree:  # a node's numbers lie within its dominator's, and apart from those of all others
            if r["up"] is not None:
                up = by[r["sample"], r["up"]]
                assert up["enter"] < r["enter"] and r["enter"] + r["span"] <= up["enter"] + up["span"]
                assert r["node"] not in reached(arcs[r["sample"]], seeds, (r["up"],))
        for s in arcs:
            own = [r["enter"] for r in tree if r["sample"] == s]
            assert sorted(own) == list(range(len(own)))


def test_ancestors_of_a_path(spark):
    tree = spark.createDataFrame([(0, k, k - 1 if k else None) for k in range(37)], "sample int, node long, parent long")
    assert rows(ancestors(tree, ["sample"]), "node", "cut", "gap") == sorted((n, c, n - c) for n in range(37) for c in range(n))


def test_greedy_plans_of_all_kinds(spark):
    rng = random.Random(11)
    arcs = worlds(rng, 12, 14, 0.09)
    live, seeds = table(spark, arcs), spark.createDataFrame([(0,)], "node long")
    want = brute_greedy(arcs, [0], 4)
    assert rows(blocking.advanced_greedy(live, seeds, 4), "rank", "node", "gain") == want
    got = lazy.celf_greedy(live, seeds, 4, batch=2)
    assert rows(got, "rank", "node", "gain") == want
    assert all(1 <= r["evaluated"] <= r["candidates"] for r in got.collect()) and sum(r["evaluated"] for r in got.collect()) < sum(r["candidates"] for r in got.collect())
    # Stored trees know less than the true gains, and are exact where no new dominator arises; the first pick always is.
    stored = rows(blocking.advanced_greedy(live, seeds, 4, refresh_every=0), "rank", "node", "gain")
    half = rows(blocking.advanced_greedy(live, seeds, 4, refresh_every=2), "rank", "node", "gain")
    assert stored[0] == half[0] == want[0] and stored == rows(blocking.max_coverage(live, seeds, 4), "rank", "node", "gain")
    after = brute_gains(arcs, [0], (half[0][1], half[1][1]))
    assert half[2][2] == sum(g for (_, v), g in after.items() if v == half[2][1])


def test_celf_needs_few_candidates(spark):
    edges = graphs.ring_lattice(spark, 400, 6, 0.15, 5)
    arcs = diffusion.edge_probabilities(edges, "const", p=0.19)
    seeds = spark.createDataFrame([(0,), (200,)], "node long")
    live = diffusion.worlds_from(arcs, seeds, 12)[1].cache()
    want = rows(blocking.advanced_greedy(live, seeds, 3), "rank", "node", "gain")
    got = lazy.celf_greedy(live, seeds, 3, batch=4)
    assert rows(got, "rank", "node", "gain") == want
    assert 10 * sum(r["evaluated"] for r in got.collect()) < sum(r["candidates"] for r in got.collect())


def test_stored_trees_against_fixed_coverage(spark):
    rng = random.Random(2)
    arcs = worlds(rng, 8, 12, 0.12)
    covers = {}
    for s, own in arcs.items():
        whole = reached(own, [0])
        for v in whole - {0}:
            covers.setdefault(v, set()).update((s, w) for w in whole - reached(own, [0], (v,)))
    want, left = [], {v: set(c) for v, c in covers.items()}
    for rank in range(1, 4):
        best = min(left, key=lambda v: (-len(left[v]), v))
        want.append((rank, best, len(left[best])))
        gone = set(left[best])
        left = {v: c - gone for v, c in left.items()}
    got = rows(blocking.max_coverage(table(spark, arcs), spark.createDataFrame([(0,)], "node long"), 3), "rank", "node", "gain")
    assert got == want


@pytest.mark.parametrize("most_arcs", [200_000, 3])
def test_plans_by_cascade(spark, most_arcs):
    """Each cascade's plan is that of its own worlds alone."""
    rng = random.Random(7)
    data = {c: worlds(rng, 5, 10, 0.13) for c in range(4)}
    live = spark.createDataFrame([(c, s, u, v) for c, own in data.items() for s, a in own.items() for u, v in a], "cascade long, sample int, src long, dst long")
    seeds = spark.createDataFrame([(c, s) for c in data for s in ([0] if c % 2 else [0, 1])], "cascade long, node long")
    got = plans(live, seeds, 3, keys=["cascade", "sample"], by=["cascade"], most_arcs=most_arcs)
    want = [(c, *p) for c, own in data.items() for p in brute_greedy(own, [0] if c % 2 else [0, 1], 3)]
    assert rows(got, "cascade", "rank", "node", "gain") == sorted(want)


def best_of(arcs, seeds, blocked):
    total = {}
    for (_, v), g in brute_gains(arcs, seeds, tuple(blocked)).items():
        total[v] = total.get(v, 0) + g
    return (best := min(total, key=lambda v: (-total[v], v), default=None)), total.get(best, 0), total


def test_replacing_and_swapping_plans_by_enumeration(spark):
    rng = random.Random(21)
    for _ in range(2):
        arcs = worlds(rng, 6, 11, 0.13)
        live, seeds = table(spark, arcs), spark.createDataFrame([(0,)], "node long")
        near = {v for own in arcs.values() for u, v in own if u == 0}
        plan = []
        for pool in (near, None):
            while len(plan) < 3:
                total = {v: g for v, g in best_of(arcs, [0], [p[0] for p in plan])[2].items() if pool is None or v in pool}
                if not total:
                    break
                v = min(total, key=lambda v: (-total[v], v))
                plan.append((v, total[v]))
        for i in reversed(range(len(plan))):
            v, g, _ = best_of(arcs, [0], [p[0] for j, p in enumerate(plan) if j != i])
            same = v == plan[i][0]
            plan[i] = (v, g)
            if same:
                break
        assert rows(blocking.greedy_replace(live, seeds, 3), "rank", "node", "gain") == [(i + 1, *p) for i, p in enumerate(plan)]
        first = spark.createDataFrame([(1, 9), (2, 10)], "rank int, node long")
        got = blocking.best_swaps(live, seeds, first, least=0.0).orderBy("rank").collect()
        nodes = [r["node"] for r in got]
        spread = lambda b: sum(len(reached(own, [0], b)) for own in arcs.values())
        assert spread(nodes) <= spread((9, 10))
        for i in range(2):  # no single exchange is better
            assert all(spread([*nodes[:i], v, *nodes[i + 1 :]]) >= spread(nodes) for v in range(1, 11))


def brute_separation(gains, worlds, leader, z):
    out = {}
    for v in {n for _, n in gains} - {leader}:
        d = [gains.get((s, leader), 0) - gains.get((s, v), 0) for s in range(worlds)]
        m = sum(d) / worlds
        out[v] = m > z * (sum((x - m) ** 2 for x in d) / (worlds - 1) / worlds) ** 0.5
    return out


def test_separation(spark):
    rng = random.Random(3)
    gains = {(s, v): rng.randint(1, 5 + v) for s in range(20) for v in range(6) if rng.random() < 0.8}
    table_ = spark.createDataFrame([(s, v, g) for (s, v), g in gains.items()], "sample int, node long, gain long")
    got = {r["node"]: r["apart"] for r in lazy.separation(table_, 20, 5, z=1.0).collect()}
    assert got == brute_separation(gains, 20, 5, 1.0) and set(got.values()) == {True, False}
    free = {r["node"]: r["apart"] for r in lazy.separation(table_, 20, 5, z=None).collect()}
    assert not any(free[v] and not got[v] for v in got)  # bounds without assumptions are the wider ones


@pytest.mark.parametrize("z", [1.5, None])
def test_racing_picks_as_all_worlds_do(spark, z):
    edges = graphs.ring_lattice(spark, 40, 4, 0.2, 9)
    arcs = diffusion.edge_probabilities(edges, "const", p=0.3)
    seeds = spark.createDataFrame([(0,)], "node long")
    got = lazy.racing_greedy(arcs, seeds, 2, first=15, batch=15, most=45, z=z, delta=0.5).orderBy("rank").collect()
    live = diffusion.worlds_from(arcs, seeds, 45)[1]
    want = blocking.advanced_greedy(live, seeds, 2).orderBy("rank").collect()
    assert [r["node"] for r in got] == [r["node"] for r in want]
    assert all(r["worlds"] in (15, 30, 45) and (r["left"] == 0 or r["worlds"] == 45) for r in got)
    own = diffusion.worlds_from(arcs, seeds, got[0]["worlds"])[1]
    assert blocking.advanced_greedy(own, seeds, 1).first()["gain"] == got[0]["gain"]


def test_frontier_coins_are_those_of_all_arcs(spark):
    edges = graphs.ring_lattice(spark, 80, 4, 0.1, 3)
    arcs = diffusion.edge_probabilities(edges, "const", p=0.3).cache()
    seeds = spark.createDataFrame([(0,), (7,)], "node long")
    met, live = diffusion.worlds_from(arcs, seeds, 5)
    every = diffusion.live_arcs(arcs, 5).cache()
    want = diffusion.cascade_reach(every, seeds, 5)
    assert rows(met, "sample", "node", "dist") == rows(want, "sample", "node", "dist")
    on = every.join(want.select("sample", F.col("node").alias("src")), ["sample", "src"], "left_semi")
    assert rows(live, "sample", "src", "dst") == rows(on, "sample", "src", "dst")
    parents = {(r["sample"], r["node"]): r["parent"] for r in met.collect()}
    dist = {(r["sample"], r["node"]): r["dist"] for r in met.collect()}
    arcs_of = {(r["sample"], r["src"], r["dst"]) for r in live.collect()}
    for (s, v), u in parents.items():
        if u is not None:
            assert u == min(a for x, a, b in arcs_of if x == s and b == v and dist[s, a] == dist[s, v] - 1)


def test_dominator_plan_blocks_what_counts(spark):
    # Two cascades on one path; each one's plan is the node after its frontier.
    arcs = spark.createDataFrame([(k, k + 1, 1.0) for k in range(9)], "src long, dst long, p double")
    state = spark.createDataFrame([(1, 0, True), (2, 4, True), (2, 3, False)], "cascade long, node long, front boolean")
    kappa = spark.createDataFrame([(1, 1.0), (2, 1.0)], "cascade long, kappa double")
    got = containment.dominator_plan(arcs, state, kappa, 2, samples=3)
    assert rows(got, "cascade", "node", "rank", "gain") == [(1, 1, 1, 27), (2, 5, 1, 15)]
