"""Alarms over streams of round evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "cascade long, round int, log_e double, alarm boolean"
STATE = "last int, totals array<double>, fired boolean"


def eprocess_stream(evidence: DataFrame, grid: list[float], *, alpha: float = 0.05) -> DataFrame:
    """Running e-process of a stream ``evidence(cascade, round, k_idx, llr)``: a row for each closed round.

    A cascade's state is its running log likelihood ratio for each factor of the grid, the last closed round, and whether it has fired. All evidence of a round must come in one batch; evidence of a round that is closed comes too late and is left out, as it would break the order on which the test's error bound rests.
    """
    bar, n = math.log(1 / alpha), len(grid)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, totals, fired = state.get if state.exists else (-1, [0.0] * n, False)
        totals, rows = list(totals), []
        data = pd.concat(list(frames))
        for turn, part in data[data["round"] > last].groupby("round", sort=True):
            for k, v in zip(part["k_idx"], part["llr"], strict=True):
                totals[int(k) - 1] += v
            top = max(totals)
            log_e = top + math.log(sum(math.exp(t - top) for t in totals)) - math.log(n)
            last, fired = int(turn), fired or log_e >= bar
            rows.append((key[0], last, log_e, fired))
        state.update((last, totals, fired))
        yield pd.DataFrame(rows, columns=["cascade", "round", "log_e", "alarm"])

    return evidence.groupBy("cascade").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, *, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window of event time, rounds of a cascade being windows: start, event_type, n. Events later than ``late`` are dropped."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")
