"""Reports over trades, bars, calendars and candidates; each is one pass of grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.gates import chain, every

STAGES = ("DEVELOPMENT", "VALIDATION", "UNSEEN_HOLDOUT")


def candles(bars: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each group of bars: extremes, return, direction, mean true range, place of the close.

    A single bar has no return and no direction; a range of zero has no place in it.
    """
    line = Window.partitionBy(*by).orderBy(order)
    before = F.lag("close").over(line)
    rows = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    one = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", order).alias("first_open"), F.max_by("close", order).alias("last_close"), F.avg("tr").alias("atr"))
    move, span = F.col("last_close") - F.col("first_open"), F.col("high") - F.col("low")
    return one.select(
        *by, "n", "high", "low", "atr", F.when(F.col("n") >= 2, move / F.nullif(F.col("first_open"), F.lit(0.0))).alias("return_over_bars"), (span / F.nullif(F.col("first_open"), F.lit(0.0))).alias("range_pct"),
        ((F.col("last_close") - F.col("low")) / F.nullif(span, F.lit(0.0))).alias("close_position"), F.when(F.col("n") < 2, "INSUFFICIENT_DATA").when(move > 0, "UP").when(move < 0, "DOWN").otherwise("FLAT").alias("direction"),
    )


def calendar_status(rows: DataFrame, us: str, zone: str, weekly: dict[int, list[tuple[int, int]]], holidays: list[str], overrides: dict[str, list[tuple[int, int]]], valid: tuple[str, str]) -> DataFrame:
    """The rows with ``status``: OPEN, CLOSED or UNKNOWN by a broker's calendar at their instant.

    Sessions are minutes of the local day, the end exclusive; Monday is 0. Holidays win over
    overrides of a date, those over the week; days outside ``valid`` are UNKNOWN.
    """
    for sessions in [*weekly.values(), *overrides.values()]:
        if any(b <= a for a, b in sessions):
            raise ValueError("a session must end after it starts, on the same day")
    local = F.from_utc_timestamp(F.timestamp_micros(us), zone)
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    within = lambda sessions: F.array_contains(F.array(F.lit(False), *[(minute >= a) & (minute < b) for a, b in sessions]), True)
    week = F.coalesce(*[F.when(F.weekday(day) == d, within(s)) for d, s in weekly.items()], F.lit(False))
    dated = F.coalesce(*[F.when(day == F.lit(d).cast("date"), within(s)) for d, s in overrides.items()], week)
    known = day.between(F.lit(valid[0]).cast("date"), F.lit(valid[1]).cast("date"))
    closed = day.isin([F.lit(d).cast("date") for d in holidays]) if holidays else F.lit(False)
    return rows.withColumn("status", F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(closed | ~dated, "CLOSED").otherwise("OPEN"))


def lots(requested: Column, minimum: str, maximum: str, step: str, cap: str) -> Column:
    """A volume as a broker takes it: bounded, cut to whole steps in decimals, and raised to the minimum.

    Null where the request is no positive number.
    """
    number = lambda x: F.lit(x).cast("decimal(20,8)")
    whole = lambda x: F.floor(x / number(step)).cast("decimal(20,0)") * number(step)
    bounded = F.least(requested.cast("decimal(20,8)"), number(maximum), number(cap))
    least = F.when(whole(number(minimum)) < number(minimum), whole(number(minimum)) + number(step)).otherwise(whole(number(minimum)))
    return F.when((requested > 0) & ~F.isnan(requested), F.when(whole(bounded) < number(minimum), least).otherwise(whole(bounded)).cast("double"))


def stop_fault(direction: Column, entry: Column, stop: Column, target: Column, distance: Column) -> Column:
    """What is wrong with the stop levels of an order, or null: their side and least distance."""
    side = F.when(direction == "LONG", 1).when(direction == "SHORT", -1)
    near = lambda gain: (gain <= 0) | (gain < distance)
    return chain([("DIRECTION", side.isNull()), ("PRICE", ~(F.least(entry, stop, target) > 0)), ("STOP_LOSS", near(side * (entry - stop))), ("TAKE_PROFIT", near(side * (target - entry)))])


def trade_report(trades: DataFrame, by: list[str], order: list[str], at_us: str = "us", span_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Results of each group of trades in their order: rates, factors, drawdown, flips, trades an hour.

    ``order`` begins with the time; equity, peaks and the trade before are carried over spans of it.
    """
    bucket = scans.span(at_us, span_us)
    rows = scans.previous(trades, by, order, bucket, before="pnl").drop(scans.BUCKET)
    rows = scans.equity_curve(rows, by, order, bucket, "pnl")
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))
    hours = (F.max(at_us) - F.min(at_us)) / 3.6e9
    return rows.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.avg("pnl").alias("expectancy"), (won / lost).alias("profit_factor"),
        F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.count_if((F.col("before") > 0) & (F.col("pnl") < 0)).alias("flips"),
        F.when(hours > 0, F.count("*") / hours).alias("trades_per_hour"), F.when((F.count("*") > 1) & (F.stddev_pop("pnl") > 0), F.avg("pnl") / F.stddev_pop("pnl") * F.sqrt(F.count("*"))).alias("sharpe_like"),
    )


def merged_reports(reports: DataFrame, by: list[str]) -> DataFrame:
    """Reports of several windows as one: sums, means weighted by trades, least factor, greatest drawdown,
    the upper median of medians, the mean of ratios."""
    n = F.sum("trades")
    mids = F.array_sort(F.collect_list("median_s"))  # a value for each window
    return reports.groupBy(*by).agg(
        n.alias("trades"), F.sum("wins").alias("wins"), (F.sum(F.coalesce("expectancy", F.lit(0.0)) * F.col("trades")) / F.nullif(n, F.lit(0))).alias("expectancy"), F.min("profit_factor").alias("profit_factor"),
        F.max("max_drawdown").alias("max_drawdown"), F.get(mids, F.floor(F.size(mids) / 2).cast("int")).alias("median_s"), F.avg("capture").alias("capture"),
    )


def account_report(trades: DataFrame, by: list[str], day: str, balance: float) -> DataFrame:
    """Daily returns of an account: best and worst day, days of ten percent, factor and rate of all trades."""
    daily = trades.groupBy(*by, day).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"), F.sum(F.greatest("pnl", F.lit(0.0))).alias("won"), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("lost"), F.count_if(F.col("pnl") > 0).alias("wins"))
    share = F.col("pnl") / balance
    return daily.groupBy(*by).agg(
        F.sum("n").alias("trades"), (F.sum("pnl") / balance).alias("total_return"), F.max(share).alias("best_day"), F.min(share).alias("worst_day"), F.count_if(share >= 0.1).alias("days_of_ten_percent"),
        (F.sum("won") / F.nullif(F.sum("lost"), F.lit(0.0))).alias("profit_factor"), (F.sum("wins") / F.sum("n")).alias("win_rate"),
    )


def promotion(stages: DataFrame, incumbent: dict[str, float], least_trades: int = 20, gain: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """(candidate, status, reasons): whether a candidate's worst later stage beats the incumbent.

    ``stages`` has a row for each candidate and stage with trades, expectancy, profit_factor,
    max_drawdown and leak. Too few trades or a missing stage end the matter before results count.
    """
    value = lambda stage, c, otherwise: F.coalesce(F.max(F.when(F.col("stage") == stage, F.col(c))), F.lit(otherwise))
    one = stages.groupBy("candidate").agg(
        F.collect_set("stage").alias("have"), *[value(s, "trades", 0).alias(f"trades_{s}") for s in STAGES], *[value(s, "leak", True).alias(f"leak_{s}") for s in STAGES],
        *[value(s, c, 0.0).alias(f"{c}_{s}") for s in STAGES[1:] for c in ("expectancy", "profit_factor", "max_drawdown")],
    )
    missing = F.array_join(F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: ~F.array_contains("have", s)), ",")
    early = F.array_compact(F.array(F.when(missing != "", F.concat(F.lit("MISSING_STAGE:"), missing)), *[x for s in STAGES for x in (F.when(F.col(f"trades_{s}") < least_trades, F.lit(f"INSUFFICIENT_EVIDENCE:{s}")), F.when(F.col(f"leak_{s}"), F.lit(f"SAFETY_REGRESSION:{s}")))]))
    both = lambda f, c: f(F.col(f"{c}_{STAGES[1]}"), F.col(f"{c}_{STAGES[2]}"))
    late = every([
        ("EXPECTANCY_NOT_IMPROVED", both(F.least, "expectancy") <= incumbent["expectancy"] + gain), ("PROFIT_FACTOR_REGRESSION", both(F.least, "profit_factor") < incumbent["profit_factor"]),
        ("DRAWDOWN_REGRESSION", both(F.greatest, "max_drawdown") > incumbent["max_drawdown"] + tolerance),
    ])
    out = one.withColumn("early", early).withColumn("reasons", F.when(F.size("early") > 0, F.col("early")).otherwise(late))
    status = F.when(F.exists("early", lambda r: r.startswith("INSUFFICIENT")), "INSUFFICIENT_EVIDENCE").when(F.size("reasons") > 0, "REJECTED").otherwise("PROMOTE_TO_SHADOW")
    return out.select("candidate", status.alias("status"), "reasons")


def cross_horizon(costs: DataFrame, key: str, cost: str, horizons: int = 4, strong: float = 5.0, epsilon: float = 1e-9) -> DataFrame:
    """(key, class): how lasting a missed move is, of decisions with a cost at all horizons."""
    one = costs.groupBy(key).agg(F.count(cost).alias("n"), F.count_if(F.col(cost) > epsilon).alias("some"), F.count_if((F.col(cost) > epsilon) & (F.col(cost) >= strong)).alias("much")).where(F.col("n") == horizons)
    kind = F.when(F.col("some") == 0, "CONSISTENT_HOLD").when(F.col("some") < 3, "TRANSIENT_MISS").when(F.col("much") >= 3, "STRONG_PERSISTENT_MISS").otherwise("PERSISTENT_DIRECTIONAL_MISS")
    return one.select(key, kind.alias("class"))


def clock_offsets(samples: DataFrame, by: str, residual: Column, offsets: list[int], tolerance: float) -> DataFrame:
    """(by, status, offset_s): the one offset that fits every sample of a group.

    ``residual`` is a sample's distance from UTC in seconds. More than one fitting offset, or none that
    fits all, is AMBIGUOUS; none that fits any is STALE_MARKET. The offsets are a short fixed list.
    """
    each = samples.select(by, residual.alias("r"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn("fits", F.abs(F.col("r") - F.col("offset")) <= tolerance)
    tried = each.groupBy(by, "offset").agg(F.count("*").alias("n"), F.count_if("fits").alias("k"))
    one = tried.groupBy(by).agg(F.count_if(F.col("k") == F.col("n")).alias("whole"), F.sum("k").alias("some"), F.max(F.when(F.col("k") == F.col("n"), F.col("offset"))).alias("offset"))
    status = F.when(F.col("whole") == 1, "CALIBRATED").when(F.col("some") > 0, "AMBIGUOUS").otherwise("STALE_MARKET")
    return one.select(by, status.alias("status"), F.when(F.col("whole") == 1, F.col("offset")).alias("offset_s"))


def compared(baseline: DataFrame, candidate: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """Differences of two benchmark runs by case, given only where case and configuration are the same."""
    a = baseline.select(key, *[F.col(c).alias(f"{c}_a") for c in ("case_hash", "config_hash", "status", *numbers)])
    b = candidate.select(key, *[F.col(c).alias(f"{c}_b") for c in ("case_hash", "config_hash", "status", *numbers)])
    differ = lambda c: ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    reason = chain([("CASE_FINGERPRINT_MISMATCH", differ("case_hash")), ("CONFIGURATION_FINGERPRINT_MISMATCH", differ("config_hash"))])
    rows = a.join(b, key).withColumn("refused", reason)
    incomplete = (F.col("status_a") != "COMPLETE") | (F.col("status_b") != "COMPLETE")
    return rows.select(key, F.coalesce("refused", F.when(incomplete, "REPLAY_STATUS_MISMATCH")).alias("reason"), *[F.when(F.col("refused").isNull(), F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta") for c in numbers])


FRAMES = ("M1", "M5", "M15", "H1")
SNAPSHOT = "struct<point:double,quote:struct<bid:double,ask:double,spread_points:double>,features:map<string,struct<return_over_bars:double,range_pct:double,close_position:double,average_true_range:double,direction:string>>>"


def market_vector(rows: DataFrame, column: str, us: str) -> DataFrame:
    """The rows with ``values`` (23), ``mask``, ``missing`` and ``fault`` out of a snapshot's JSON.

    Spread in points, five numbers of each of four time frames, the hour as sine and cosine; a value
    that isn't there is null and masked, with the reason. A faulty quote refuses the snapshot.
    """
    s = rows.withColumn("s", F.from_json(column, SNAPSHOT))
    q, point = F.col("s.quote"), F.col("s.point")
    fault = chain([
        ("SCHEMA_INVALID", q.isNull()), ("POINT_INVALID", ~F.coalesce(point > 0, F.lit(False))), ("QUOTE_INVALID", q.bid.isNull() | q.ask.isNull() | q.spread_points.isNull() | (q.bid <= 0) | (q.ask < q.bid) | (q.spread_points < 0)),
        ("QUOTE_INVALID", F.abs(q.spread_points - (q.ask - q.bid) / point) > F.greatest(F.lit(1e-9), 1e-9 * F.abs(q.spread_points))),
    ])
    frame = lambda f, c: F.col("s.features").getItem(f)[c]
    code = lambda d: F.when(F.upper(d) == "UP", 1.0).when(F.upper(d) == "FLAT", 0.0).when(F.upper(d) == "DOWN", -1.0)
    angle = 2 * F.pi() * F.pmod(F.col(us), F.lit(86_400_000_000)) / 8.64e10
    values = [q.spread_points, *[x for f in FRAMES for x in (*[frame(f, c) for c in ("return_over_bars", "range_pct", "close_position", "average_true_range")], code(frame(f, "direction")))], F.sin(angle), F.cos(angle)]
    out = s.withColumn("fault", fault).withColumn("values", F.array(*values)).withColumn("mask", F.transform("values", lambda v: v.isNotNull()))
    return out.withColumn("missing", F.size(F.filter("mask", lambda m: ~m))).drop("s")
