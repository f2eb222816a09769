"""Positions of a live strategy, one at a time by symbol, closed by the first of thirteen rules.

What closes a position is a table: ``bounds`` turns the fractions of its profile into numbers when it
opens, and ``hits`` compares each later tick with them. A replay needs no state machine. Every tick that
could open a position is followed to its own exit by a range join (a profile bounds how long it is held),
with running extremes by windows; which of these positions were really taken is a chain: the next one is
the first that could open after the exit. Heads of chains are the ones that open after all earlier exits,
and their followers are found by doubling the pointers, in about log n rounds. A stream keeps the open
position of each symbol as group state and applies the same table to arrays of ticks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import scans
from tidemark.operators.asof import asof, in_ranges
from tidemark.session import cut

# The rules in the order in which they are tried.
EXITS = (
    "POSITION_PRICE_UNAVAILABLE", "EMERGENCY_BROKER_STOP", "STRATEGIC_REGIME_INVALIDATED", "SPREAD_BLOWOUT", "VOLATILITY_BLOWOUT", "TAKE_PROFIT", "MAE_STOP", "MFE_GIVEBACK",
    "MICRO_REVERSAL", "STRATEGY_INVALIDATION", "MOMENTUM_REVERSAL", "NO_PROGRESS", "MAX_DURATION",
)
#: What a profile allows, for strategies that follow a range and those that follow momentum: fractions
#: of the expected move, persistence, and seconds.
PROFILES = {
    "micro": (0.25, 0.50), "micro_back": (0.10, 0.15), "against": (0.20, 0.35), "arm": (0.25, 0.50), "trail": (0.75, 1.00), "back": (0.35, 0.50),
    "idle_floor": (6.0, 12.0), "idle_per_point": (1.0, 0.50), "idle_cap": (10.0, 20.0), "longest": (30.0, 45.0),
}
INVALID, LEAST_POINTS, LEAST_BACK = 0.25, 1.0, 0.5

TICK = "us bigint, bid double, ask double, point double, momentum double, persistence double, spread_expansion double, volatility double, active boolean, longs boolean, shorts boolean, signal int, expected double, strategy string"
COLUMNS = [c.split()[0] for c in TICK.split(", ")]
TRADES = "symbol bigint, strategy string, side int, entry_us bigint, exit_us bigint, entry double, pnl_points double, mfe_points double, mae_points double, reason string"
#: What is known of a position when it opens, and what changes while it is held.
OPENED = "side int, entry double, since bigint, name string, follows boolean, target double, stop double, invalid double, arm double, trail double, back double, micro double, micro_back double, against double, idle_us double, longest_us double"
HELD = "mfe double, mae double, mfe_us bigint"
_OPENED, _HELD = ([c.split()[0] for c in x.split(", ")] for x in (OPENED, HELD))
DAY_US, CHUNK = 86_400_000_000, 256


@dataclass(frozen=True)
class Limits:
    target: float = 1.5
    stop: float = 1.0
    emergency_points: float = 100.0
    longest: float = 60.0
    spread_points: float = 40.0
    expansion_points: float = 10.0
    volatility: float = 0.005


def bounds(ticks: DataFrame, limits: Limits) -> DataFrame:
    """The ticks with ``opens`` and the columns of OPENED of the position that each would open."""
    c, name = F.col, F.coalesce(F.nullif("strategy", F.lit("")), F.lit("range_rejection"))
    follows = F.contains(F.lower(name), F.lit("momentum"))
    share = lambda n: F.when(follows, PROFILES[n][1]).otherwise(PROFILES[n][0])
    move = F.greatest(F.coalesce("expected", F.lit(0.0)), F.lit(1.0))
    least = lambda x, floor=LEAST_POINTS: F.greatest(F.lit(floor), move * x)
    side = F.signum("signal").cast("int")
    idle = F.least(share("idle_cap"), F.greatest(share("idle_floor"), move * share("idle_per_point")))
    arm = least(share("arm"))
    found = {
        "side": side, "entry": F.when(side > 0, c("ask")).otherwise(c("bid")), "since": c("us"), "name": name, "follows": follows, "target": least(limits.target), "stop": least(limits.stop), "invalid": least(INVALID),
        "arm": arm, "trail": F.greatest(arm, move * share("trail")), "back": least(share("back"), LEAST_BACK), "micro": least(share("micro")), "micro_back": least(share("micro_back"), LEAST_BACK), "against": share("against"),
        "idle_us": idle * 1e6, "longest_us": F.least(F.lit(limits.longest), share("longest")) * 1e6,
    }
    opens = (c("signal") != 0) & c("active") & F.when(c("signal") > 0, c("longs")).otherwise(c("shorts"))
    return ticks.withColumns({f"o_{n}": v for n, v in found.items()}).withColumn("opens", F.coalesce(opens, F.lit(False)))


def hits(t: SimpleNamespace, limits: Limits) -> dict[str, object]:
    """Which rules a tick meets, for columns and for arrays alike.

    ``t`` has the position's bounds, the tick, ``mark`` and ``pnl`` there, and the extremes up to it.
    """
    spread, fallen, held, turned = (t.ask - t.bid) / t.point, t.mfe - t.pnl, t.us - t.since, (t.side * t.momentum < 0) & (t.persistence >= t.against)
    met = [
        t.mark <= 0, t.pnl <= -limits.emergency_points, ~t.active | ~t.permitted, (spread > limits.spread_points) | (t.spread_expansion / t.point > limits.expansion_points), t.volatility > limits.volatility,
        t.pnl >= t.target, t.pnl <= -t.stop, (t.mfe >= t.trail) & (fallen >= t.back) & (fallen >= spread * 0.5), turned & (t.mfe >= t.micro) & (fallen >= t.micro_back) & (fallen >= spread * 0.25),
        turned & (t.pnl < -t.invalid) & (t.mfe < t.arm), turned & (t.mfe < t.micro) & t.follows, (held >= t.idle_us) & (t.us - t.mfe_us >= t.idle_us) & (t.mfe < t.arm), held >= t.longest_us,
    ]
    return dict(zip(EXITS, met, strict=True))


def _paths(ticks: DataFrame, limits: Limits) -> DataFrame:
    """A row for each position that could be opened and each tick that it could see: up to its longest time, and the first one from there on."""
    later = [c for c in COLUMNS if c not in ("signal", "expected", "strategy")]
    seen = ticks.select("symbol", *later)
    could = bounds(ticks, limits).where("opens").select("symbol", *[F.col(f"o_{n}").alias(n) for n in _OPENED])
    ends = could.withColumn("lo", F.col("since") + 1).withColumn("hi", F.col("since") + F.ceil("longest_us").cast("bigint") - 1)
    near = in_ranges(ends, seen, "symbol", "lo", "hi", "us", int(limits.longest * 1e6)).select("symbol", *_OPENED, *later)
    last = asof(ends.withColumn("at_", F.col("hi") + 1), seen, "symbol", "at_", "us", later[1:], DAY_US, forward=True, prefix="q_").where("q_us is not null")
    return near.unionByName(last.select("symbol", *_OPENED, *[F.col(f"q_{c}").alias(c) for c in later]))


def _closed(ticks: DataFrame, limits: Limits) -> DataFrame:
    """The exit of each position that could be opened; none for one that nothing closes."""
    side, mark = F.col("side"), F.when(F.col("side") > 0, F.col("bid")).otherwise(F.col("ask"))
    rows = _paths(ticks, limits).withColumn("mark", mark)
    rows = rows.withColumn("pnl", F.when(F.col("mark") <= 0, 0.0).otherwise(side * (F.col("mark") - F.col("entry")) / F.col("point")))
    line = Window.partitionBy("symbol", "since").orderBy("us")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumns({"mfe": F.greatest(zero, F.max("pnl").over(so_far)), "mae": F.least(zero, F.min("pnl").over(so_far)), "rises": F.col("pnl") > F.greatest(zero, F.coalesce(F.max("pnl").over(before), zero))})
    rows = rows.withColumn("mfe_us", F.coalesce(F.last(F.when(F.col("rises"), F.col("us")), ignorenulls=True).over(so_far), F.col("since")))
    t = SimpleNamespace(**{c: F.col(c) for c in rows.columns}, permitted=F.when(side > 0, F.col("longs")).otherwise(F.col("shorts")))
    why = F.coalesce(*[F.when(test, F.lit(name)) for name, test in hits(t, limits).items()])
    out = F.struct(F.col("us").alias("exit_us"), F.col("entry"), F.col("pnl"), F.col("mfe"), F.col("mae"), F.col("reason"), F.col("name"), F.col("side"))
    return rows.withColumn("reason", why).where("reason is not null").groupBy("symbol", "since").agg(F.min_by(out, "us").alias("x")).select("symbol", "since", "x.*")


def taken(could: DataFrame, span_us: int = DAY_US) -> DataFrame:
    """(symbol, since) of the positions (symbol, since, exit_us) that are taken one at a time, in order.

    One without an exit stays open. Chains begin where a position opens after all earlier exits.
    """
    forever = F.lit(1 << 62)
    rows = cut(could.select("symbol", "since", F.coalesce("exit_us", forever).alias("exit_us")))
    free = scans.greatest_before(rows, ["symbol"], ["since"], scans.span("since", span_us), {"busy": F.col("exit_us")})
    chosen = cut(free.where("busy is null or since > busy").select("symbol", "since"))
    follows = asof(rows.withColumn("at_", F.col("exit_us") + 1).where(F.col("exit_us") < forever), rows.select("symbol", F.col("since").alias("us"), F.lit(0).alias("x")), "symbol", "at_", "us", ["x"], span_us, forward=True)
    jump = cut(follows.where("q_us is not null").select("symbol", "since", F.col("q_us").alias("to")))
    while True:
        reached = jump.join(chosen, ["symbol", "since"]).select("symbol", F.col("to").alias("since"))
        fresh = cut(reached.join(chosen, ["symbol", "since"], "left_anti").distinct())
        if fresh.isEmpty():
            return chosen
        chosen = cut(chosen.unionByName(fresh))
        jump = cut(jump.join(jump.select("symbol", F.col("since").alias("to"), F.col("to").alias("further")), ["symbol", "to"]).select("symbol", "since", F.col("further").alias("to")))


def replayed(ticks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Closed trades of each symbol; the times of a symbol's ticks differ."""
    could = bounds(ticks, limits).where("opens").select("symbol", F.col("us").alias("since"))
    exits = cut(_closed(ticks, limits))
    rows = could.join(exits.select("symbol", "since", "exit_us"), ["symbol", "since"], "left")
    six = lambda c: F.round(c, 6)
    return exits.join(taken(rows), ["symbol", "since"]).select(
        "symbol", F.col("name").alias("strategy"), "side", F.col("since").alias("entry_us"), "exit_us", "entry", six("pnl").alias("pnl_points"), six("mfe").alias("mfe_points"), six("mae").alias("mae_points"), "reason"
    )


def _followed(position: dict, rows: pd.DataFrame, limits: Limits) -> tuple[int | None, tuple]:
    """The place of the tick that closes a position, if one does, and the trade; the position's extremes go on."""
    v = {c: rows[c].to_numpy() for c in COLUMNS if c not in ("signal", "expected", "strategy")}
    mark = v["bid"] if position["side"] > 0 else v["ask"]
    pnl = np.where(mark <= 0, 0.0, position["side"] * (mark - position["entry"]) / v["point"])
    mfe, mae = np.maximum.accumulate(np.append(position["mfe"], pnl)), np.minimum.accumulate(np.append(position["mae"], pnl))
    best = np.maximum.accumulate(np.append(position["mfe_us"], np.where(pnl > mfe[:-1], v["us"], np.iinfo(np.int64).min)))[1:]
    t = SimpleNamespace(**{n: position[n] for n in _OPENED}, **v, mark=mark, pnl=pnl, mfe=mfe[1:], mfe_us=best, permitted=v["longs"] if position["side"] > 0 else v["shorts"])
    met = np.stack(list(hits(t, limits).values()))
    at = np.flatnonzero(met.any(axis=0))
    if len(at):
        i = int(at[0])
        return i, (position["name"], position["side"], position["since"], int(v["us"][i]), position["entry"], round(float(pnl[i]), 6), round(float(mfe[i + 1]), 6), round(float(mae[i + 1]), 6), EXITS[int(met[:, i].argmax())])
    position |= {"mfe": float(mfe[-1]), "mae": float(mae[-1]), "mfe_us": int(best[-1])}
    return None, ()


def streamed(ticks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same over a stream: a symbol's position is kept between batches and after a restart."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position = dict(zip([*_OPENED, *_HELD], state.get, strict=True)) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("us", kind="stable").reset_index(drop=True)
        opens, out, i = np.flatnonzero(rows["opens"].to_numpy()), [], 0
        while i < len(rows):
            if position is None:
                at = opens[np.searchsorted(opens, i) :]
                if not len(at):
                    break
                row = rows.iloc[int(at[0])]
                position = {n: row[f"o_{n}"] for n in _OPENED} | {"mfe": 0.0, "mae": 0.0, "mfe_us": row["us"]}
                i = int(at[0]) + 1
                continue
            end, trade = _followed(position, rows.iloc[i : i + CHUNK], limits)
            i += CHUNK if end is None else end + 1
            if end is not None:
                out.append(trade)
                position = None
        if position is not None:
            plain = {n: v.item() if isinstance(v, np.generic) else v for n, v in position.items()}
            state.update(tuple(plain[n] for n in (*_OPENED, *_HELD)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *t) for t in out], columns=[c.split()[0] for c in TRADES.split(", ")])

    return bounds(ticks, limits).groupBy("symbol").applyInPandasWithState(step, TRADES, f"{OPENED}, {HELD}", "append", GroupStateTimeout.NoTimeout)
