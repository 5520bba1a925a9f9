"""Line dedup: lines found in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.llm._common import SPACE, ascii_lower, checkpoint


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, most_sent: int = 500_000) -> DataFrame:
    """Drop the lines whose normalised form stands in at least ``min_docs`` documents.

    A text is cut at line feeds; a line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys shorter than ``min_chars`` code points are never dropped. Lines are exploded and hashed (MD5 of the key), the distinct documents of each hash are counted, the lines are joined with the frequent hashes, and each document is reassembled from the positions that stay. Up to ``most_sent`` frequent hashes are sent to all tasks, so that the lines of a very frequent one stay where they are; more are joined by a shuffle, which Spark splits where a hash is hot. No line's text is shuffled, only hashes and positions; each document is moved once.

    Returns the columns of ``docs``, with ``text`` replaced by what is left, and ``n_lines``, ``n_dropped`` (long); input columns of these two names are replaced.

    Defined cases: a null or empty text is one empty line, and becomes an empty text; a document is a distinct pair of id and text, so a repeated row counts once and each of its copies is returned; a null id is an id like others; an empty table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), F.split(body, "\n", -1).alias("_lines"))
    lines = base.select("_id", "_key", F.posexplode("_lines").alias("_pos", "_line")).select("_id", "_key", "_pos", F.trim("_line", F.lit(SPACE)).alias("_line"))
    lines = lines.where(F.char_length("_line") >= min_chars).select("_id", "_key", "_pos", F.unhex(F.md5(ascii_lower(F.col("_line")))).alias("_hash"))
    frequent = lines.groupBy("_hash").agg(F.count_distinct("_key").alias("_docs")).where(F.col("_docs") >= min_docs).select("_hash")
    frequent = checkpoint(frequent)
    if frequent.count() <= most_sent:
        frequent = F.broadcast(frequent)
    drops = lines.join(frequent, "_hash").groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_hash_of")).agg(F.collect_set("_pos").alias("_drops"))
    n_lines = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), "_drops")
    kept = F.when(F.col("_drops").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("_lines", p)), "\n"))
    out = base.join(drops, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_hash_of")), "left")
    columns = [kept.alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))


