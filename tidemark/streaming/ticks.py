"""Structured Streaming over ticks: zero-lateness drops, windows, sessions, exactly-once appends.

The stateful operators keep one small state for each symbol: the last accepted time and counters, or
the last twenty mids. They accept what the batch operators accept, whatever the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACCEPTED = "symbol bigint, us bigint, bid double, ask double, stale bigint, out_of_order bigint"
FEATURES = "symbol bigint, us bigint, mid double, momentum double, rolling_range double, n int"


def accepted(ticks: DataFrame) -> DataFrame:
    """Ticks later than all before them, with how many were dropped as equal or earlier so far.

    Not a watermark: lateness is zero and judged by key in arrival order (``arrival``).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, stale, late = state.get if state.exists else (-1, 0, 0)
        out = []
        for pdf in frames:
            for us, bid, ask in pdf.sort_values("arrival")[["us", "bid", "ask"]].itertuples(index=False):
                if us == last:
                    stale += 1
                elif us < last:
                    late += 1
                else:
                    last = us
                    out.append((key[0], us, bid, ask, stale, late))
        state.update((int(last), stale, late))
        yield pd.DataFrame(out, columns=["symbol", "us", "bid", "ask", "stale", "out_of_order"])

    return ticks.groupBy("symbol").applyInPandasWithState(step, ACCEPTED, "last bigint, stale bigint, late bigint", "append", GroupStateTimeout.NoTimeout)


def features(ticks: DataFrame, window: int = 20) -> DataFrame:
    """Momentum and range over the last ``window`` ticks of each symbol, current one included."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (recent,) = state.get if state.exists else ([],)
        recent, out = list(recent), []
        for pdf in frames:
            for us, mid in pdf.sort_values("us")[["us", "mid"]].itertuples(index=False):
                recent = [*recent[-(window - 1) :], float(mid)]
                out.append((key[0], us, mid, round(mid - recent[0], 6), round(max(recent) - min(recent), 6), len(recent)))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["symbol", "us", "mid", "momentum", "rolling_range", "n"])

    return ticks.groupBy("symbol").applyInPandasWithState(step, FEATURES, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def bars(ticks: DataFrame, width: str = "15 minutes", settle: str = "30 seconds") -> DataFrame:
    """Tumbling bars, each emitted once its end is ``settle`` behind the newest tick."""
    rows = ticks.withWatermark("ts", settle).groupBy("symbol", F.window("ts", width))
    return rows.agg(F.min_by("mid", "ts").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "ts").alias("close"), F.count("*").alias("n")).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "2 hours", settle: str = "30 seconds") -> DataFrame:
    """Runs of ticks without a gap longer than ``gap``."""
    rows = ticks.withWatermark("ts", settle).groupBy("symbol", F.session_window("ts", gap))
    return rows.agg(F.count("*").alias("n"), F.avg("mid").alias("mean_mid")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "mean_mid")


def append_once(batch: DataFrame, path: str, key: str) -> None:
    """For ``foreachBatch``: append rows whose key isn't in the table yet, so a retry adds nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
        fresh = fresh.join(known, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # a table that isn't there yet
            raise
    fresh.write.mode("append").parquet(path)
