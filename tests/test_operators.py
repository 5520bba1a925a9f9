"""Small graphs with known answers, metamorphic checks, and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from diffspark.functions.lineage import checkpoint, counted
from diffspark.functions.rng import uniform
from diffspark.operators import blocking, detect, diffusion, graph, metrics, sequential
from diffspark.sources import graphs


def path(spark, n):
    return graphs.both_ways(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hash_uniform_is_the_known_number(spark):
    assert spark.range(1).select(uniform(7, 3, 12, 55)).first()[0] == 0.5557588553056121


def test_uniform_does_not_depend_on_partitioning(spark):
    for n in (1, 5):
        got = spark.range(100).repartition(n).select("id", uniform(7, "id").alias("u"))
        assert rows(got, "id", "u") == rows(spark.range(100).select("id", uniform(7, "id").alias("u")), "id", "u")


def test_path_hops_components_and_stats(spark):
    edges = path(spark, 5).union(graphs.both_ways(spark.createDataFrame([(10, 11)], "src long, dst long")))
    assert rows(graph.reach(edges, nodes(spark, 0)), "node", "dist") == [(i, i) for i in range(5)]
    assert rows(graph.reach(edges, nodes(spark, 0), mask=nodes(spark, 1, 2)), "node", "dist") == [(0, 0), (1, 1), (2, 2)]
    assert rows(graph.components(edges), "node", "component") == [(i, 0) for i in range(5)] + [(10, 10), (11, 10)]
    assert rows(graph.graph_stats(edges), "n", "m", "n_components", "lcc") == [(7, 5, 2, 5)]


def test_long_path_components_end(spark):
    assert graph.components(path(spark, 60)).where("component <> 0").isEmpty()


@pytest.mark.parametrize(("p", "blocked", "spread"), [(1.0, [], 5.0), (1.0, [2], 2.0), (0.0, [], 1.0)])
def test_spread_on_a_path(spark, p, blocked, spread):
    arcs = diffusion.edge_probabilities(path(spark, 5), "const", p=p)
    live = diffusion.live_arcs(arcs, 3)
    got = diffusion.expected_spread(live, nodes(spark, 0), 3, blocked=nodes(spark, *blocked) if blocked else None)
    assert got.first()["spread"] == spread


@pytest.mark.parametrize(("delay", "bad"), [(0, 3), (2, 4)])
def test_competing_campaigns_on_a_path(spark, delay, bad):
    live = diffusion.live_arcs(diffusion.edge_probabilities(path(spark, 7), "const", p=1.0), 1)
    out = diffusion.competing(live, nodes(spark, 0), nodes(spark, 6), 1, delay=delay)
    assert out.where("campaign = 'bad'").count() == bad


def test_sir_boundaries(spark):
    runs = diffusion.outbreaks(nodes(spark, 0), 1, beta=1.3)
    assert diffusion.sir_times(path(spark, 5), runs, horizon=0.0).count() == 1
    still = diffusion.sir_times(path(spark, 5), diffusion.outbreaks(nodes(spark, 0), 1, beta=1e-9), horizon=50.0)
    assert rows(diffusion.snapshot(still, 50.0), "node", "state") == [(0, 2)]


def test_sir_grows_with_the_horizon(spark):
    edges = graphs.ring_lattice(spark, 40, 4, 0.1, 3)
    times = diffusion.sir_times(edges, diffusion.outbreaks(nodes(spark, 0, 5), 3, beta=1.3), horizon=2.0)
    few, many = (set(rows(diffusion.snapshot(times, t), "sim_id", "node")) for t in (0.5, 2.0))
    assert few <= many and (0, 0) in few


def test_throttling_and_blocking_never_add(spark):
    edges = graphs.ring_lattice(spark, 60, 4, 0.1, 3)
    arcs = diffusion.edge_probabilities(edges, "const", p=0.4)
    cascades = spark.createDataFrame([(c, 1.5, c) for c in range(5)], "cascade long, kappa double, node long")
    free = set(rows(diffusion.episodes(arcs, cascades), "cascade", "node"))
    half = spark.range(60).crossJoin(cascades.select("cascade")).select("cascade", F.col("id").alias("node"), F.lit(0.5).alias("rho"))
    assert set(rows(diffusion.episodes(arcs, cascades, throttled=half), "cascade", "node")) <= free
    shut = cascades.select("cascade", (F.col("cascade") + 1).alias("node"), F.lit(1).alias("from_round"))
    assert set(rows(diffusion.episodes(arcs, cascades, blocked=shut), "cascade", "node")) <= free
    whole = half.withColumn("rho", F.lit(1.0))
    assert set(rows(diffusion.episodes(arcs, cascades, throttled=whole), "cascade", "node")) == free


def test_min_vertex_cut_against_enumeration():
    rng = random.Random(3)
    for _ in range(100):
        n = rng.randint(3, 7)
        arcs = [e for e in itertools.permutations(range(n), 2) if rng.random() < 0.35]
        target, seeds = n - 1, [0]

        def reached(cut):
            seen, stack = set(), list(seeds)
            while stack:
                u = stack.pop()
                if u not in seen and u not in cut:
                    seen.add(u)
                    stack += [b for a, b in arcs if a == u]
            return target in seen

        if not reached(()) or (0, target) in arcs:
            assert blocking.min_vertex_cut(arcs, seeds, target) == []
            continue
        least = next(k for k in range(n) if any(not reached(c) for c in itertools.combinations(range(1, n - 1), k)))
        cut = blocking.min_vertex_cut(arcs, seeds, target)
        assert len(cut) == least and not reached(cut)


def test_planners_agree_on_a_small_world(spark):
    edges = graphs.ring_lattice(spark, 40, 4, 0.2, 9)
    live = diffusion.live_arcs(diffusion.edge_probabilities(edges, "const", p=0.35), 6).cache()
    seeds = nodes(spark, 0)
    greedy = blocking.advanced_greedy(live, seeds, 2).orderBy("rank").collect()
    slow = blocking.greedy_by_removal(live, seeds, 6, 2).orderBy("rank").collect()
    before = diffusion.cascade_reach(live, seeds, 6).count()
    assert slow[0]["node"] == greedy[0]["node"] and before - slow[0]["spread"] == greedy[0]["gain"]
    assert slow[1]["spread"] == slow[0]["spread"] - greedy[1]["gain"]


def test_removal_losses_against_removal(spark):
    rng, arcs = random.Random(4), {}
    for w in (0, 1):
        arcs[w] = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(16)})

    def reached(w, gone):
        met, todo = {0}, [0]
        while todo:
            u = todo.pop()
            new = {b for a, b in arcs[w] if a == u and b != gone} - met
            met |= new
            todo += new
        return met

    live = spark.createDataFrame([(w, a, b) for w in arcs for a, b in arcs[w]], "sample int, src long, dst long")
    starts = spark.createDataFrame([(w, 0) for w in arcs], "sample int, node long")
    tree = checkpoint(graph.explore(live, starts, keys=["sample"])[0])
    got = [r for r in rows(blocking.removal_losses(tree, live, ["sample"]), "sample", "node", "lost") if r[1]]
    assert got == [(w, v, len(reached(w, None)) - len(reached(w, v))) for w in arcs for v in sorted(reached(w, None) - {0})] and len(got) > 6


def test_exact_spread(spark):
    def g(i, arcs, seeds, blocked):
        return (i, [{"u": a, "v": b, "p": p} for a, b, p in arcs], seeds, blocked)

    line = [(k, k + 1, 1.0) for k in range(4)]
    triangle = [(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5)]
    data = [g(1, line, [0], []), g(2, line, [0], [2]), g(3, [(1, 2, 1.0)], [0], []), g(4, triangle, [0], [])]
    got = blocking.exact_spread(spark.createDataFrame(data, "graph_id long, edges array<struct<u: long, v: long, p: double>>, seeds array<long>, blocked array<long>"))
    assert rows(got, "graph_id", "spread") == [(1, 4.0), (2, 1.0), (3, 0.0), (4, 1.25)]


def test_detectors_run_and_score_only_infected(spark):
    edges = path(spark, 6)
    snap = spark.createDataFrame([(1, i, 1) for i in range(5)], "sim_id long, node long, state int")
    for name, run in detect.DETECTORS.items():
        got = rows(run(edges, snap), "node", "score")
        assert {v for v, _ in got} == set(range(5)), name
        if name in ("jordan", "distance", "closeness", "betweenness", "rumor"):
            assert max(got, key=lambda x: x[1])[0] == 2, name


def test_metrics(spark):
    scores = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0)], "sim_id long, node long, score double")
    truth = spark.createDataFrame([(1, 1)], "sim_id long, source long")
    got = metrics.instance_metrics(scores, truth).first()
    assert got["rr"] == pytest.approx(1 / 3) and got["top1"] == 0 and got["top3"] == 1
    p = spark.createDataFrame([(1, i, math.log(x)) for i, x in enumerate((0.5, 0.3, 0.15, 0.05))], "sim_id long, node long, score double")
    assert metrics.instance_metrics(p, truth).first()["css"] == 3


def test_round_evidence(spark):
    data = [(1, 1, n, k, math.log(1 - q), y) for n, y, qs in ((0, 1, (0.1, 0.3)), (1, 0, (0.5, 0.8))) for k, q in enumerate(qs)]
    got = sequential.round_evidence(spark.createDataFrame(data, "cascade long, round int, node long, k_idx int, log1mq double, outcome int")).first()
    assert got["llr"] == pytest.approx(math.log(3) + math.log(0.4))


def test_evidence_is_that_of_the_exposure_table(spark):
    rng = random.Random(3)
    arcs = diffusion.edge_probabilities(graphs.both_ways(spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(90)], "src long, dst long")), "wc")
    act = diffusion.episodes(arcs, spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0)], "cascade long, node long, kappa double"))
    grid = sequential.factor_grid(1.5, 6.0, 0.6)
    want = rows(sequential.round_evidence(sequential.exposures(arcs, act, grid)), "cascade", "round", "k_idx", "llr")
    got = rows(sequential.evidence(arcs, act, grid), "cascade", "round", "k_idx", "llr")
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 8
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_traversals_read_few_buckets_of_stored_arcs(spark, monkeypatch):
    edges = checkpoint(path(spark, 6))
    want = rows(graph.reach(edges, nodes(spark, 3)), "node", "dist")
    cascades = spark.createDataFrame([(0, 3, 2.0)], "cascade long, node long, kappa double")
    arcs = diffusion.edge_probabilities(edges, "wc")
    act = rows(diffusion.episodes(arcs, cascades), "node", "round")
    monkeypatch.setattr(graph, "STORED", 0)
    monkeypatch.setattr(graph, "A_BUCKET", 1)
    dealt = graph.Dealt(edges, ["src"])
    assert dealt.buckets == 11
    near = dealt.around(nodes(spark, 3).withColumnRenamed("node", "src"), 1)
    assert near.count() < 10 and rows(near.where("src = 3"), "src", "dst") == [(3, 2), (3, 4)]
    assert rows(graph.reach(edges, nodes(spark, 3)), "node", "dist") == want
    assert rows(diffusion.episodes(arcs, cascades), "node", "round") == act


def test_cusum_closed_form(spark):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(40)]
    ev = spark.createDataFrame([(1, i, 1, v) for i, v in enumerate(x)], "cascade long, round int, k_idx int, llr double")
    s, want = 0.0, []
    for v in x:
        s = max(0.0, s + v)
        want.append(s)
    got = [v for _, v in rows(sequential.cusum(ev, 1), "round", "statistic")]
    assert got == pytest.approx(want)


def test_e_benjamini_hochberg(spark):
    e = spark.createDataFrame([(1, 100.0), (2, 30.0), (3, 1.0), (4, 0.5)], "cascade long, e double")
    assert rows(sequential.e_benjamini_hochberg(e, 0.1), "cascade") == [(1,), (2,)]
    assert sequential.e_benjamini_hochberg(e.limit(0), 0.1).isEmpty()


def test_e_benjamini_hochberg_ranks_values_beyond_doubles(spark):
    e = spark.createDataFrame([(1, 800.0), (2, 1200.0), (3, 900.0), (4, -1.0)], "cascade long, log_e double").withColumn("e", F.exp("log_e"))
    assert rows(sequential.e_benjamini_hochberg(e, 0.5), "k", "cascade") == [(1, 2), (2, 3), (3, 1)]


def test_throttle_takes_the_fewest(spark):
    r = spark.createDataFrame([(1, 1, 5.0, 0.4), (1, 2, 3.0, 0.4), (1, 3, 1.0, 0.2)], "cascade long, node long, weight double, mass double")
    assert rows(sequential.throttle_by_weight(r, 0.5), "node") == [(1,), (2,)]


def test_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# graph\n0 1\n1 0\n2\t1\n\n3 3\n")
    assert rows(graphs.read_edge_list(spark, str(tmp_path / "g.txt")), "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    (tmp_path / "w.txt").write_text("0.5\n0.25\n")
    (tmp_path / "e.txt").write_text("0 1\n1 2\n")
    assert rows(graphs.read_weighted_edges(spark, str(tmp_path / "e.txt"), str(tmp_path / "w.txt")), "src", "dst", "w") == [(0, 1, 0.5), (1, 2, 0.25)]
    pairs = spark.createDataFrame([(0, 70, 5), (1, 5, 9)], "line long, src long, dst long")
    assert rows(graphs.relabel_by_appearance(pairs), "src", "dst") == [(0, 1), (1, 2)]
    assert graphs.grid(spark, 3, 4).count() == 2 * (3 * 3 + 2 * 4)
    assert graphs.star_of_paths(spark, 3, 4, 0.2).where("p < 1").count() == 3
    m = graphs.erdos_renyi(spark, 200, 0.05, 4).count() / 2
    assert 800 < m < 1200
    graphs.append_summary(spark.createDataFrame([(1, 2.0)], "a long, b double"), str(tmp_path / "s"))
    graphs.append_summary(spark.createDataFrame([(3, "x")], "a long, c string"), str(tmp_path / "s"))
    assert set(graphs.read_summary(spark, str(tmp_path / "s")).columns) == {"a", "b", "c"}


def test_report_shapes(spark):
    r = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0), ("b", 2, 4.0)], "method string, i long, v double")
    got = metrics.paired_difference(r, "a", "b", "v", ["i"]).first()
    assert (got["n"], got["mean"], got["win_rate"]) == (2, -0.5, 0.75)
    assert rows(metrics.latest(r, ["method"], "i"), "method", "v") == [("a", 4.0), ("b", 4.0)]
    assert rows(metrics.pivoted(r, ["i"], "method", ["a", "b"], "v"), "i", "a", "b") == [(1, 2.0, 3.0), (2, 4.0, 4.0)]


def test_logistic_in_a_session_that_has_observed(spark):
    counted(spark.range(3).toDF("id"))  # such a session can't be sent to tasks, nor can what holds it
    data = [(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 0), (6.0, 1), (9.0, 1)]
    r = spark.createDataFrame([(x, bool(y)) for x, y in data], "x double, harmful boolean")
    p = {t["x"]: t["p"] for t in r.withColumn("p", sequential.fit_logistic(r, ["x"])).collect()}
    w = math.log(p[2.0] / (1 - p[2.0])) - math.log(p[1.0] / (1 - p[1.0]))
    n, mean = len(data), sum(x for x, _ in data) / len(data)
    variance = sum((x - mean) ** 2 for x, _ in data) / (n - 1)
    # At the optimum both derivatives of the mean loss and its penalty of 1 / n are 0.
    assert sum(p[x] - y for x, y in data) / n == pytest.approx(0, abs=1e-4)
    assert sum((p[x] - y) * x for x, y in data) / n + w * variance / n == pytest.approx(0, abs=1e-4)
    one = spark.createDataFrame([(1.0, True), (2.0, True)], "x double, harmful boolean")
    assert rows(one.withColumn("p", sequential.fit_logistic(one, ["x"])), "p") == [(1.0,), (1.0,)]
