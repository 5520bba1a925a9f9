"""Containment, message passing and streaming alarms on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from diffspark.operators import containment, diffusion, sequential
from diffspark.operators.message_passing import message_passing
from diffspark.sources import graphs
from diffspark.streaming.alarms import eprocess_stream


def test_plans_never_add_harm(spark):
    edges = graphs.ring_lattice(spark, 60, 4, 0.1, 3).cache()
    arcs = diffusion.edge_probabilities(edges, "const", p=0.45).cache()
    cascades = spark.createDataFrame([(c, 1.2, 7 * c) for c in range(4)], "cascade long, kappa double, node long")
    act = diffusion.episodes(arcs, cascades).cache()
    alarms = sequential.alarms(sequential.growth(act), "size", 3)
    state = containment.state_at(act, alarms).cache()
    before = {(r["cascade"], r["node"]) for r in act.collect()}
    plan = containment.dominator_plan(arcs, state, cascades.select("cascade", "kappa"), 3, samples=4)
    after = {(r["cascade"], r["node"]) for r in containment.contained(arcs, cascades, alarms, plan).collect()}
    assert after <= before and len(after) < len(before)
    for other in (containment.degree_plan(edges, state, 3), containment.proximity_plan(edges, state, 3)):
        assert other.join(state, ["cascade", "node"]).isEmpty() and other.groupBy("cascade").count().where("count > 3").isEmpty()


def test_message_passing_finds_the_middle(spark):
    edges = graphs.both_ways(spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    snap = spark.createDataFrame([(1, i, 1) for i in range(2, 7)] + [(2, 0, 1)], "sim_id long, node long, state int")
    got = {(r["sim_id"], r["node"]): r["score"] for r in message_passing(edges, snap, beta=1.3, horizon=2.0).collect()}
    assert len(got) == 6 and got[2, 0] == 0.0
    assert max((k for k in got if k[0] == 1), key=got.get) == (1, 4)
    assert got[1, 2] == pytest.approx(got[1, 6])


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    grid = [1.5, 3.0]
    rows = [(c, t, k, rng.gauss(0.2, 1.0)) for c in range(3) for t in range(6) for k in (1, 2)]
    schema = "cascade long, round int, k_idx int, llr double"
    late = [(0, 1, 1, 50.0), (0, 1, 2, 50.0)]
    for part in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3] + late):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = eprocess_stream(stream, grid).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["cascade"], r["round"]): r["log_e"] for r in spark.table("alarms").collect()}
    batch = sequential.eprocess(spark.createDataFrame(rows, schema), 2, grid)
    want = {(r["cascade"], r["round"]): r["log_e"] for r in batch.collect()}
    assert got == pytest.approx(want)
    assert math.isfinite(max(got.values()))
