"""What the operators share: words, row carrying, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a character list and as patterns. Python's ``bytes.split()`` cuts at the same six.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: bytes | str | None) -> list[bytes]:
    """Lower-cased words of a text: A-Z lower-cased, cut at ASCII white space."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that ``spark.checkpoint.dir`` names. Only a session of one machine may do without: a temporary folder is set for it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="diffspark-"))
    return df.checkpoint()


def gathered(df: DataFrame, rows_each: int = 50_000, least: int = 4) -> DataFrame:
    """``checkpoint`` of ``df``, read in as many partitions as its rows need, and ``least`` at least: a task writes files for each shuffle, however few rows it has, so a small table in hundreds of partitions costs more disk than its rows."""
    out = checkpoint(df)
    return out.coalesce(max(least, -(-out.count() // rows_each)))


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle has in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that is free within this Python worker back to the system: workers go on to other stages, and what they have held once they would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
