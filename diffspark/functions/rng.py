"""Counter-based random numbers: a hash of the keys, the same in every run, partitioning and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """In [0, 1): the first 32 bits of the MD5 of the seed and keys, joined by '|'."""
    parts = [F.lit(k).cast("string") if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def exponential(rate: Column | float, *args) -> Column:
    return -F.log(1 - uniform(*args)) / rate


def normal(seed: int, *keys) -> Column:
    """Standard normal by Box and Muller, from two uniforms."""
    r = F.sqrt(-2 * F.log(1 - uniform(seed, *keys, 1)))
    return r * F.cos(2 * math.pi * uniform(seed, *keys, 2))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number in DuckDB SQL."""
    joined = " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
