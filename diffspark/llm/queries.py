"""The registered queries of the training-data operators, thin over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import langid, quality, toxicity
from diffspark.llm._common import documents, remainder
from diffspark.llm.imatch import imatch
from diffspark.llm.line_dedup import line_dedup
from diffspark.llm.minhash import near_duplicates
from diffspark.llm.mixing import mix
from diffspark.llm.packing import pack
from diffspark.llm.runs import looped, periodic_runs
from diffspark.llm.secrets import secret_spans
from diffspark.llm.spelling import occurrences, spelling_variants, vocabulary
from diffspark.llm.sql import SQL
from diffspark.llm.suffix_dedup import suffix_dedup
from diffspark.llm.suffix_tree import suffix_tree_scores

__all__ = ["QUERIES", "SQL"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=5, percent=75)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir), among=remainder(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity(docs, model, threshold=0.7).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "offending")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality(docs, quality.fit(docs, labels(spark, sf_dir), among=remainder(F.col("doc_id"), 3) != 1))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 where labelled good, 0.5 where labelled bad."""
    return labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), weights=quality_weights(labels(spark, sf_dir)))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(documents(spark, sf_dir), held_out=10)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), length=50)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = langid.fit(docs, among=remainder(F.col("doc_id"), 3) != 1)
    return langid.language(docs.select("doc_id", "text"), filters).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(documents(spark, sf_dir))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    kinds = ("assign", "access", "hex")
    counts = [(F.size("spans") - F.size(F.array_remove("spans.kind", k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return out.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = periodic_runs(documents(spark, sf_dir).select("doc_id", looped(F.col("text"), crc).alias("text")), least_length=24, least_exponent=3)
    # Runs come by start, then period: only a greater exponent takes the place of an earlier one.
    top = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = occurrences(documents(spark, sf_dir), least_chars=6, drop_one_in=199)
    return spelling_variants(vocabulary(words, least=5), ratio=5)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_langid": op9_langid,
    "op10_imatch": op10_imatch,
    "op11_secrets": op11_secrets,
    "op12_runs": op12_runs,
    "op13_spelling": op13_spelling,
}
