"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, n: int, key: Column) -> DataFrame:
    """At most ``n`` rows, those whose key's MD5 comes first: the same rows in every run. Only the columns of ``rows`` are sorted, so pass keys and labels, not texts."""
    return rows.withColumn("_order", F.md5(F.coalesce(key.cast("string"), F.lit("")))).orderBy("_order", *rows.columns).limit(n).drop("_order")


def first_by_hash_each(rows: DataFrame, n: int, key: Column, group: str) -> DataFrame:
    """Of each value of ``group`` at most ``n`` rows, the same as ``first_by_hash`` takes, in one pass. Spark cuts each task's part to ``n`` rows a group before it shuffles them, for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``."""
    hashed = rows.withColumn("_order", F.md5(F.coalesce(key.cast("string"), F.lit(""))))
    order = W.partitionBy(group).orderBy("_order", *rows.columns)
    return hashed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_order", "_place")


def labelled(docs: DataFrame, labels: DataFrame, column: str, *, doc_id: str = "doc_id", text: str = "text", per_class: int, among: Column | None = None) -> DataFrame:
    """Texts of at most ``per_class`` documents labelled 0 and as many labelled 1: id, text, label.

    ``among``, over the column ``doc_id``, says which rows of ``labels`` may be learnt from (None: all). Rows that have more than one label count with the larger one, those whose label is null not at all; of rows of one id that differ, the least text counts. The keys are at most ``2 * per_class`` rows, a bound that lets them be broadcast.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (F.lit(True) if among is None else among)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    keys = first_by_hash(own.where("label = 0"), per_class, F.col("doc_id")).union(first_by_hash(own.where("label = 1"), per_class, F.col("doc_id")))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(keys.withColumnRenamed("doc_id", "id")), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
