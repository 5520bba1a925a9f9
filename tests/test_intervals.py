"""Open intervals and bounded balls against plain Python."""

import random

from diffspark.operators import graph
from diffspark.operators.intervals import most_open, open_counts
from diffspark.sources import graphs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_open_counts(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.randint(0, 20)) for a in (rng.randint(0, 200) for _ in range(300))] + [(5, 5), (None, 3), (3, None), (9, 1)]
    table = spark.createDataFrame(spans, "a int, z int").repartition(5)
    good = [(a, z) for a, z in spans if a is not None and z is not None and a <= z]
    times = sorted({(a, False) for a, _ in good} | {(z, True) for _, z in good})
    want = [(t, after, sum(a <= t and (z > t if after else z >= t) for a, z in good)) for t, after in times]
    assert rows(open_counts(table, "a", "z"), "time", "after", "open") == want
    assert most_open(table, "a", "z").first()["open"] == max(w[2] for w in want)
    assert most_open(table.limit(0), "a", "z").first()["open"] == 0


def test_ball(spark):
    rng = random.Random(6)
    pairs = list({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    edges = graphs.both_ways(spark.createDataFrame(pairs, "src long, dst long")).cache()
    hops = {s: dict(rows(graph.reach(edges, spark.createDataFrame([(s,)], "node long")), "node", "dist")) for s in (pairs[0][0], pairs[1][0])}
    for size in (1, 7, 100):
        want = {s: sorted((n, d) for d, n in sorted((d, n) for n, d in h.items())[:size]) for s, h in hops.items()}
        for s in hops:
            assert rows(graph.ball(edges, spark.createDataFrame([(s,)], "node long"), size), "node", "dist") == want[s]
        both = graph.ball(edges, spark.createDataFrame([(s, s) for s in hops], "key long, node long"), size, keys=["key"])
        assert rows(both, "key", "node", "dist") == sorted((s, n, d) for s in hops for n, d in want[s])
