"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The session's folder in ``spark.checkpoint.dir``, which all executors share; only a session of one machine may do without, and gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="diffspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's ``shared_folder``."""
    shared_folder(df)
    return df.checkpoint()


def kept(df: DataFrame, *by: str) -> DataFrame:
    """``checkpoint`` of a large table that is read again and again, as compressed columns, in folders by the columns ``by``: a few times smaller, but there until the session's folder goes."""
    folder = f"{shared_folder(df)}/{uuid.uuid4()}"
    df.write.partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpoint`` of ``df`` and its number of rows, by one job."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]
