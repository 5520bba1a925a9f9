"""Graph sources: edge lists, generators, graphs derived from the star schema; run-record sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.functions.lineage import checkpoint
from diffspark.functions.rng import uniform


def both_ways(pairs: DataFrame) -> DataFrame:
    """Arcs (src, dst) of an undirected simple graph, each edge in both directions; loops and repeated edges are dropped."""
    once = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that met in an order line, for each line: src even (customer), dst odd (supplier)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def contact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_ways(contact_pairs(spark, sf_dir))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated integer pairs, one edge a line; lines beginning with '#' and blank ones are skipped. Compressed files are read as they are."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return both_ways(lines.select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst")))


def read_weighted_edges(spark: SparkSession, edges_path: str, weights_path: str) -> DataFrame:
    """Edges joined with a file of weights by line number: src, dst, w. Line numbers come from the files' order; each is one task's range plus an offset for each partition."""
    def numbered(path: str, name: str) -> DataFrame:
        rows = spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
        return spark.createDataFrame(rows, f"line long, {name} string")

    part = F.split(F.trim("edge"), r"\s+")
    rows = numbered(edges_path, "edge").join(numbered(weights_path, "weight"), "line")
    return rows.select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"), F.col("weight").cast("double").alias("w"))


def relabel_by_appearance(pairs: DataFrame) -> DataFrame:
    """Dense ids from 0 in order of first appearance for ``pairs(line, src, dst)``: src, dst. The ids are counted over labels, which are sorted by range, not in one task."""
    seen = pairs.select("line", F.posexplode(F.array("src", "dst")).alias("side", "label")).groupBy("label").agg(F.min(F.struct("line", "side")).alias("first"))
    ids = numbered(seen, "first", name="id").select("label", "id")
    out = pairs.join(ids.withColumnRenamed("label", "src").withColumnRenamed("id", "s"), "src").join(ids.withColumnRenamed("label", "dst").withColumnRenamed("id", "d"), "dst")
    return out.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def numbered(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Dense numbers from 0 in the given order, which must tell all rows apart: rows are dealt out and sorted by ranges, and a range's offset is the sum of those before; only their counts are ordered as a whole."""
    ranged = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(offsets, "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """Each pair by a hash coin, as independent ones would fall. Pairs are drawn by skips between successes in each row of the lower triangle, cut into stretches of about 8 / p cells that begin anew, so that the work is that of the edges, not of all pairs. A stretch may hold as many edges as it has cells."""
    width = max(1, int(8 / p)) if p > 0 else n
    parts = spark.range(n).withColumnRenamed("id", "u").where(F.col("u") > 0).select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("u") - 1) / width))).alias("part"))
    if p <= 0:
        return both_ways(parts.where("false").select(F.col("u").alias("src"), F.col("part").alias("dst")))
    log_q = math.log(1 - p) if p < 1 else -math.inf
    # The k-th gap is geometric; as many are drawn as the stretch has cells left at most, in rounds of 32.
    open_ = parts.withColumn("at", F.lit(-1).cast("long")).withColumn("k", F.lit(0))
    found = None
    while True:
        gaps = open_.select("u", "part", "at", F.explode(F.sequence(F.col("k") + 1, F.col("k") + 32)).alias("j"))
        gaps = gaps.withColumn("gap", (F.floor(F.log(1 - uniform(seed, "u", "part", "j")) / log_q) + 1).cast("long"))
        run = W.partitionBy("u", "part").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
        cells = checkpoint(gaps.withColumn("at", F.col("at") + F.sum("gap").over(run)))
        hits = cells.where((F.col("at") < width) & (F.col("part") * width + F.col("at") < F.col("u"))).select(F.col("u").alias("src"), (F.col("part") * width + F.col("at")).alias("dst"))
        found = hits if found is None else found.union(hits)
        open_ = checkpoint(cells.groupBy("u", "part").agg(F.max("at").alias("at"), F.max("j").alias("k")).where((F.col("at") < width) & (F.col("part") * width + F.col("at") < F.col("u"))))
        if open_.isEmpty():
            return both_ways(found)


def ring_lattice(spark: SparkSession, n: int, k: int, rewire: float, seed: int) -> DataFrame:
    """Small world: each node linked with its k/2 followers on a ring; a link's far end moves to a random node with chance ``rewire``."""
    links = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("step"))
    far = F.when(uniform(seed, "src", "step", 1) < rewire, F.floor(uniform(seed, "src", "step", 2) * n)).otherwise((F.col("src") + F.col("step")) % n)
    return both_ways(links.select("src", far.cast("long").alias("dst")))


def grid(spark: SparkSession, rows: int, columns: int, shortcuts: float = 0.0, seed: int = 0) -> DataFrame:
    """Rectangular grid, with a random shortcut at a share of its nodes."""
    cells = spark.range(rows * columns)
    right = cells.where((F.col("id") + 1) % columns != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    far = cells.where(uniform(seed, "id", 1) < shortcuts).select(F.col("id").alias("src"), F.floor(uniform(seed, "id", 2) * (rows * columns)).cast("long").alias("dst"))
    return both_ways(right.union(down).union(far))


def star_of_paths(spark: SparkSession, branches: int, length: int, p: float) -> DataFrame:
    """Directed star of paths from node 0: src, dst, p; the first arc of a branch has probability ``p``, the others 1."""
    steps = spark.range(branches * length).select(F.floor(F.col("id") / length).alias("branch"), (F.col("id") % length).alias("at"), (F.col("id") + 1).alias("dst"))
    return steps.select(F.when(F.col("at") == 0, 0).otherwise(F.col("dst") - 1).cast("long").alias("src"), "dst", F.when(F.col("at") == 0, p).otherwise(1.0).alias("p"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour lists: src, neighbours."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


RUN_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("run_id", T.StringType()), ("method", T.StringType()), ("i", T.LongType()), ("source", T.LongType()), ("n_inf", T.LongType()), ("rr", T.DoubleType()), ("ed", T.DoubleType()))])


def write_instances(rows: DataFrame, path: str) -> None:
    """Per-instance records as compressed JSON lines."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def read_instances(spark: SparkSession, path: str, schema: T.StructType = RUN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_summary(rows: DataFrame, path: str) -> None:
    """Append summary rows; columns may differ from those written before, and are merged when read."""
    rows.write.mode("append").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)
