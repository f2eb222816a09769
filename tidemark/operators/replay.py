"""Deterministic replay of ticks through a position state machine, and resampled intervals.

State depends on the row before, so a replay is one ordered pass for each (candidate, symbol,
segment): the segments cut at gaps bound a group. Columns decide entries; the machine holds exits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.order import positioned
from tidemark.session import cut

DAY_US = 86_400_000_000
EXITS = ("STOP", "TARGET", "TRAILING", "GIVE_BACK", "MAX_HOLD", "SEGMENT_END")
TRADES = "candidate string, symbol bigint, segment bigint, direction string, entry_us bigint, exit_us bigint, entry_fill double, exit_fill double, pnl double, mfe double, mae double, exit_reason string"


@dataclass(frozen=True)
class Policy:
    """Exit rules of a candidate, in price units and ticks; entries follow momentum over ``look`` ticks."""

    name: str
    look: int = 3
    threshold: float = 5.0
    stop: float = 20.0
    target: float = 30.0
    trail_from: float = 15.0
    trail: float = 8.0
    give_back: float = 0.6
    max_ticks: int = 40


class Machine:
    """One position at a time: flat, long (+1) or short (-1)."""

    def __init__(self, policy: Policy) -> None:
        self.policy, self.side = policy, 0
        self.recent: list[float] = []

    def step(self, us: int, bid: float, ask: float, last: bool) -> dict | None:
        """A closed trade, if this tick closes one. Exits are judged in the order of EXITS."""
        mid, p = (bid + ask) / 2, self.policy
        out = None
        if self.side:
            now = (bid - self.entry) if self.side > 0 else (self.entry - ask)
            self.best, self.worst, self.held = max(self.best, now), min(self.worst, now), self.held + 1
            tests = (now <= -p.stop, now >= p.target, self.best >= p.trail_from and now <= self.best - p.trail, self.best >= p.trail and now <= self.best * (1 - p.give_back), self.held >= p.max_ticks, last)
            why = next((name for name, hit in zip(EXITS, tests, strict=True) if hit), None)
            if why:
                out = {"direction": "LONG" if self.side > 0 else "SHORT", "entry_us": self.since, "exit_us": us, "entry_fill": self.entry, "exit_fill": bid if self.side > 0 else ask, "pnl": round(now, 6), "mfe": round(self.best, 6), "mae": round(self.worst, 6), "exit_reason": why}
                self.side = 0
        elif len(self.recent) >= p.look and not last:
            move = mid - self.recent[-p.look]
            if abs(move) > p.threshold:
                self.side = 1 if move > 0 else -1
                self.entry, self.since, self.best, self.worst, self.held = (ask if self.side > 0 else bid), us, 0.0, 0.0, 0
        self.recent = [*self.recent[-(p.look - 1) :], mid] if p.look > 1 else [mid]
        return out


def segmented(ticks: DataFrame, gap_us: int) -> DataFrame:
    """Ticks with the number of gaps longer than ``gap_us`` before them."""
    return scans.segments(ticks, ["symbol"], "us", ["us", "bid", "ask"], gap_us, scans.span("us", DAY_US)).drop("gap")


def replay(ticks: DataFrame, policies: list[Policy], gap_us: int) -> DataFrame:
    """All trades of all candidates; each (symbol, segment) is replayed by itself.

    Segments stand one after another in sorted partitions and are read as a stream, so memory holds
    a batch whatever their length. Ticks of one instant go by their prices.
    """
    rows = segmented(ticks.select("symbol", "us", "bid", "ask"), gap_us)
    nan = F.lit(float("nan"))
    line = rows.select(F.col("symbol").cast("bigint").alias("symbol"), F.col("segment").cast("bigint").alias("segment"), "us", F.coalesce("bid", nan).alias("bid"), F.coalesce("ask", nan).alias("ask"))
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in TRADES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, machines, out = None, [], []

        def step(last: bool) -> None:
            symbol, segment, us, bid, ask = held
            for machine in machines:
                if trade := machine.step(us, bid, ask, last):
                    out.append({"candidate": machine.policy.name, "symbol": symbol, "segment": segment, **trade})

        for batch in batches:
            for tick in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fresh = held is None or tick[:2] != held[:2]
                if held is not None:
                    step(fresh)
                if fresh:
                    machines = [Machine(p) for p in policies]
                held = tick
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        if held is not None:
            step(True)
            yield pa.RecordBatch.from_pylist(out, schema)

    tasks = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes with much work become one task
    return line.repartition(tasks, "symbol", "segment").sortWithinPartitions("symbol", "segment", "us", "bid", "ask").mapInArrow(run, TRADES)


def resampled(clusters: DataFrame, by: str, cluster: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, s, n): the sums of as many clusters as a group has, drawn from them with replacement.

    A cluster's place in its group is a slot; in each draw the slot gets the cluster at the place that a
    hash of (seed, draw, slot) names, so nothing depends on partitions and each draw has all its slots.
    """
    placed = positioned(clusters.select(by, cluster, "s", "n"), [by, cluster])
    sizes = placed.groupBy(by).agg(F.count("*").alias("size"), F.min("position").alias("first"))
    slots = placed.join(sizes, by).select(by, "size", (F.col("position") - F.col("first")).alias("slot"), "s", "n")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.col("size")
    asked = slots.select(by, "size", "slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(by, "draw", place.alias("slot"))
    return asked.join(slots.select(by, "slot", "s", "n"), [by, "slot"]).select(by, "draw", "s", "n")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, by: str, trials: int = 1, draws: int = 4000, least: int = 20, seed: int = 14) -> DataFrame:
    """(by, clusters, status, mean, lower, upper): an interval for the mean, resampling whole clusters with replacement.

    Its tails are 2.5 % divided by the number of trials (Bonferroni). Fewer than ``least`` clusters
    give no interval but the status INSUFFICIENT_CLUSTERS.
    """
    if trials < 1 or draws < 1000 or least < 2:
        raise ValueError("at least one trial, 1000 draws and two clusters are needed")
    sums = cut(rows.groupBy(by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")))
    whole = sums.groupBy(by).agg(F.count("*").alias("clusters"), (F.sum("s") / F.sum("n")).alias("mean"))
    enough = sums.join(whole.where(F.col("clusters") >= least).select(by), by, "left_semi")
    means = resampled(enough, by, cluster, draws, seed).groupBy(by, "draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    tail = 0.025 / trials
    ends = means.groupBy(by).agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))  # a value for each draw
    return whole.join(ends, by, "left").select(by, "clusters", F.when(F.col("clusters") >= least, "ESTIMATED").otherwise("INSUFFICIENT_CLUSTERS").alias("status"), "mean", "lower", "upper")
