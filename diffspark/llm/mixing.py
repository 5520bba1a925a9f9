"""Mixing sources to target weights: whole epochs, then weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm._common import WORD, checkpoint

#: Documents for each bucket of a source's key order; a bucket is what one task sorts at a time.
BUCKET = 2_000


def hash_uniform(key: Column) -> Column:
    """In (0, 1], from the first 52 bits of an MD5: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, *, cycle: int = 3, most: float = 3.0) -> DataFrame:
    """Targets of the sources of ``sizes(source, size)``: source, source_size, n_docs, target.

    Sources in code point order, null last, weigh 1, 2, ... ``cycle``, repeating. They share the total of all sizes by weight; a target stops at ``most`` times its source's size, and the excess is shared again by weight until none is above. Closed form: in order of cap by weight, the sources before the water level have their cap, the others the level times their weight. The windows run over one row for each source.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("_w", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double")).withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    table = table.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    level = F.min(F.when(fits, F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(W.partitionBy())["level"]
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return table.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, cycle: int = 3, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Sample documents so that each source comes near its target share of words.

    Size of a document: its words. A source whose target is q times its size and a part is taken q times whole (complete epochs), and the part is drawn by Efraimidis-Spirakis sampling: each document has the key -ln(u)/weight, u from a hash of its id and weight from ``weights(doc_id, weight)`` (positive, one row for each id; null or absent: 1), and documents are taken in key order while the prefix sum of their sizes stays under the rest of the budget; the one that crosses it is taken if that comes nearer.

    The prefix sums don't gather a source in one task: a source's key range is cut into buckets of about 2,000 documents by a monotone function of the key, buckets are summed first, and a document's prefix is its bucket's plus a window within the bucket.

    Returns the columns of ``docs`` and ``size``, ``source_size``, ``target`` (double), ``epochs`` (times that the document is taken, long), ``taken`` = epochs * size; input columns of these names are replaced. DataFrame functions only.

    Defined cases: a null text has size 0; a null source is a source of its own, last in order; equal keys go by id, then size; repeated rows are taken equally often, as one document whose size counts for each copy; documents of size 0 add no words and may be taken or not; all sizes 0, or an empty table: targets are 0 and nothing is taken.
    """
    named = ("size", "source_size", "target", "epochs", "taken")
    row = F.xxhash64(F.col(doc_id), F.col(source), F.col(text))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(row.alias("_row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size"))
    if weights is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(weights.select(F.col("doc_id").alias("id"), F.col("weight").cast("double")), "id", "left").na.fill({"weight": 1.0})
    sized = checkpoint(sized.groupBy("_row", "id", "source", "size", "weight").agg(F.count("*").alias("copies")))
    plan = mixing_plan(sized, cycle=cycle, most=most, seed=seed).select(F.struct("_row", "id").alias("_plan"), *(F.col(c).alias(f"_{c}") for c in named)).alias("p")
    rows = docs.select(F.struct("*").alias("_doc"), row.alias("_of"), F.col(doc_id).alias("_id"))
    met = rows.join(plan, (F.col("_of") == F.col("_plan._row")) & F.col("_id").eqNullSafe(F.col("_plan.id")))
    return met.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in named), *(F.col(f"_{c}").alias(c) for c in named))


def mixing_plan(sized: DataFrame, *, cycle: int = 3, most: float = 3.0, seed: int = 7) -> DataFrame:
    """How often to take each row of ``sized(id, source, size, weight, copies)``: with source_size, target, epochs, taken. ``sized`` is read twice."""
    u = hash_uniform(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    targets = source_targets(sized.withColumn("size", F.col("size") * F.col("copies")), cycle=cycle, most=most)
    targets = targets.withColumn("_whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_buckets", F.ceil(F.col("n_docs") / BUCKET))
    means = sized.groupBy(F.col("source").alias("_of")).agg(F.avg("weight").alias("_mean"))
    targets = targets.join(means, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    keyed = sized.withColumn("_k", -F.log(u) / F.col("weight"))
    here = F.col("k.source").eqNullSafe(F.col("t.source"))
    keyed = keyed.alias("k").join(targets.alias("t"), here).select("k.*", *(F.col(f"t.{c}") for c in targets.columns if c != "source"))
    # Monotone in the key, and spread over the buckets where weights are near their mean.
    keyed = keyed.withColumn("_bucket", F.least(F.col("_buckets") - 1, F.floor(F.col("_buckets") * (1 - F.exp(-F.col("_k") * F.col("_mean"))))))
    words = F.col("size") * F.col("copies")
    sums = keyed.groupBy("source", "_bucket").agg(F.sum(words).alias("_sum"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    keyed = keyed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = W.partitionBy("source", "_bucket").orderBy("_k", "id", "size", "_row").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    epochs = F.col("_whole") + (start + words / 2 <= F.col("_rest")).cast("long")
    return keyed.withColumn("epochs", epochs).withColumn("taken", F.col("epochs") * F.col("size"))
