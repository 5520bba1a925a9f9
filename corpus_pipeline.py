"""From raw documents to packed training sequences, in five stages. Each takes empty tables, and reads and returns the columns of documents alone, whatever other columns it is given; the last returns pieces."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import langid
from diffspark.llm._common import checkpoint, documents
from diffspark.llm.line_dedup import line_dedup
from diffspark.llm.minhash import near_duplicates
from diffspark.llm.mixing import mix
from diffspark.llm.packing import pack
from diffspark.llm.queries import labels, quality_weights

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language holds a smaller share of its n-grams is in no language that the filters know.
LEAST_LANGUAGE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without text or letters (null and empty texts too), or with few n-grams of any language, go. Repeated rows and null ids are judged each."""
    out = langid.language(docs, langid.fit(docs))
    return out.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more have; a text of such lines alone becomes empty. Repeated rows count as one document and stay each."""
    return line_dedup(docs, min_docs=10).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id. Of its rows all that differ stay, if it has several; documents without words, and those with a null id, stay as they are."""
    found = near_duplicates(docs).where("kept and doc_id is not null")
    kept = checkpoint(found.groupBy("doc_id").agg((F.count("*") > 1).alias("_several")))
    rows = docs.select(COLUMNS)
    out = rows.join(kept, "doc_id", "left_semi" if (once := kept.where("_several").isEmpty()) else "inner")
    if not once:
        out = out.where("not _several").select(COLUMNS).union(out.where("_several").select(COLUMNS).distinct())
    return out.select(COLUMNS).union(rows.where("doc_id is null"))


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The weights of ``op6_mixing``; None where ``sf_dir`` has no labels."""
    try:
        own = labels(spark, sf_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return quality_weights(own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, weighted by the quality labels of ``sf_dir`` where it has any. Repeated rows are taken equally often, a null source is a source of its own, empty texts may be taken or not."""
    return mix(docs, weights=label_weights(spark, sf_dir)).where("epochs > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences; an empty text is its end alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenisation and n-gram filters have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
