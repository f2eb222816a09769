"""Scans along keys carried over buckets, and exact quantiles: no task takes a key's whole history.

The oracles state the same with windows over whole keys and with sorted percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import order, quantiles, scans
from tidemark.operators.quantiles import UPPER, linear, nearest
from tidemark.plans.registry import projection, query
from tidemark.session import stored

DAY_US, GAP_US, GUARD_US = 86_400_000_000, 7_200_000_000, 60_000_000
#: Arrivals in a bucket.
ARRIVALS = 1 << 14
TRADES = ["us", "trade_id", "pnl", "volume"]

_SEGMENTS = """
    WITH once AS (SELECT symbol, us, arrival FROM (SELECT symbol, us, arrival, row_number() OVER (PARTITION BY symbol, us ORDER BY arrival) AS rn FROM arrivals WHERE bid > 0 AND ask >= bid) q WHERE rn = 1),
    gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY symbol ORDER BY us) AS gap FROM once),
    segments AS (SELECT symbol, us, arrival, gap, sum(CASE WHEN gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM gaps)
"""
_W = "(PARTITION BY symbol ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def total(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")


def over(a: Column, b: Column) -> Column:
    """The quotient of doubles as IEEE states it, where b is zero too."""
    unbounded = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, unbounded).otherwise(F.try_divide(a, b))


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in arrival order with the time of the one before."""
    rows = projection(spark, sf_dir, "arrivals")
    return scans.previous(rows, ["symbol"], ["arrival"], scans.span("arrival", ARRIVALS), p="us")


def in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid quotes, the first of each instant, with the gap before and the segment."""
    rows = projection(spark, sf_dir, "arrivals").where("bid > 0 AND ask >= bid").groupBy("symbol", "us").agg(F.min("arrival").alias("arrival"))
    return scans.segments(rows, ["symbol"], "us", ["us"], GAP_US, scans.span("us", DAY_US))


@query("""
    SELECT symbol, CAST(sum(CASE WHEN us = p THEN 1 ELSE 0 END) AS bigint) AS stale, CAST(sum(CASE WHEN us < p THEN 1 ELSE 0 END) AS bigint) AS out_of_order, count(*) AS n
    FROM (SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY arrival) AS p FROM arrivals) q GROUP BY symbol""")
def stale_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals at or before the instant of the one before."""
    us, p = F.col("us"), F.col("p")
    return arrived(spark, sf_dir).groupBy("symbol").agg(total(us == p).alias("stale"), total(us < p).alias("out_of_order"), F.count("*").alias("n"))


@query("""
    SELECT symbol, CAST(sum(CASE WHEN us - p > 7200000000 THEN 1 ELSE 0 END) AS bigint) AS gaps, max(us - p) AS longest_us, round(avg(us - p) / 1e6, 4) AS mean_s
    FROM (SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY arrival) AS p FROM arrivals) q GROUP BY symbol""")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between arrivals."""
    gap = F.col("us") - F.col("p")
    return arrived(spark, sf_dir).groupBy("symbol").agg(total(gap > GAP_US).alias("gaps"), F.max(gap).alias("longest_us"), F.round(F.avg(gap) / 1e6, 4).alias("mean_s"))


@query("""
    WITH f AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY arrival) AS p, row_number() OVER (PARTITION BY symbol, us, bid, ask ORDER BY arrival) AS rn FROM arrivals)
    SELECT symbol, count(*) AS total, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS bigint) AS distinct_quotes, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS bigint) AS duplicates, CAST(sum(CASE WHEN us = p THEN 1 ELSE 0 END) AS bigint) AS stale,
      CAST(sum(CASE WHEN us < p THEN 1 ELSE 0 END) AS bigint) AS out_of_order, CAST(sum(CASE WHEN us - p > 7200000000 THEN 1 ELSE 0 END) AS bigint) AS gaps, CAST(sum(CASE WHEN bid <= 0 OR ask <= 0 THEN 1 ELSE 0 END) AS bigint) AS invalid,
      CAST(sum(CASE WHEN ask = bid THEN 1 ELSE 0 END) AS bigint) AS zero_spread, CAST(sum(CASE WHEN ask < bid THEN 1 ELSE 0 END) AS bigint) AS negative_spread, count(DISTINCT us - us % 86400000000) AS days,
      count(DISTINCT CASE WHEN us % 86400000000 < 25200000000 THEN 'ASIA' WHEN us % 86400000000 < 46800000000 THEN 'LONDON' WHEN us % 86400000000 < 75600000000 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END) AS sessions
    FROM f GROUP BY symbol""")
def tick_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each symbol's arrivals; a quote is a duplicate if an equal one came before."""
    us, p, bid, ask = (F.col(c) for c in ("us", "p", "bid", "ask"))
    hour = us % DAY_US
    session = F.when(hour < 25_200_000_000, "ASIA").when(hour < 46_800_000_000, "LONDON").when(hour < 75_600_000_000, "NEW_YORK").otherwise("OFF_HOURS")
    faults = arrived(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("total"), total(us == p).alias("stale"), total(us < p).alias("out_of_order"), total(us - p > GAP_US).alias("gaps"), total((bid <= 0) | (ask <= 0)).alias("invalid"), total(ask == bid).alias("zero_spread"), total(ask < bid).alias("negative_spread"),
        F.size(F.collect_set(us - hour)).cast("bigint").alias("days"), F.size(F.collect_set(session)).cast("bigint").alias("sessions"),
    )
    once = projection(spark, sf_dir, "arrivals").groupBy("symbol", "us", "bid", "ask").agg(F.lit(1).alias("x")).groupBy(F.col("symbol").alias("s")).agg(F.count("*").alias("distinct_quotes"))
    return faults.join(once, faults.symbol.eqNullSafe(once.s)).drop("s").withColumn("duplicates", F.col("total") - F.col("distinct_quotes"))


@query("""
    WITH f AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY arrival) AS p, row_number() OVER (PARTITION BY symbol, us, bid, ask ORDER BY arrival) AS rn FROM arrivals)
    SELECT count(*) AS total, CAST(sum(CASE WHEN bid > 0 AND ask >= bid THEN 1 ELSE 0 END) AS bigint) AS valid, CAST(sum(CASE WHEN rn > 1 OR us = p THEN 1 ELSE 0 END) AS bigint) AS stale, CAST(sum(CASE WHEN us < p THEN 1 ELSE 0 END) AS bigint) AS backwards FROM f""")
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, stale and backward arrivals of all symbols; an equal quote seen before is stale."""
    us, p = F.col("us"), F.col("p")
    rows = arrived(spark, sf_dir)
    # of equal quotes all but the first are stale, and the first if it repeats the instant before it
    quotes = rows.groupBy("symbol", "us", "bid", "ask").agg(F.count("*").alias("n"), F.min_by(F.coalesce(us == p, F.lit(False)), "arrival").alias("first_stale"), total(us < p).alias("back"))
    valid = F.sum(F.when((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")), F.col("n")).otherwise(0))
    stale = F.sum(F.col("n") - 1 + F.when(F.col("first_stale"), 1).otherwise(0))
    return quotes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), valid.alias("valid"), stale.alias("stale"), F.sum("back").alias("backwards"))


@query(_SEGMENTS + "SELECT symbol, us, arrival, CAST(segment AS bigint) AS segment FROM segments")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each quote."""
    return in_segments(spark, sf_dir).select("symbol", "us", "arrival", F.col("segment").cast("bigint").alias("segment"))


@query(_SEGMENTS + "SELECT symbol, CAST(segment AS bigint) AS segment, count(*) AS n, min(us) AS start_us, max(us) AS end_us, max(CASE WHEN gap > 7200000000 THEN gap END) AS gap_before FROM segments GROUP BY symbol, segment")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, bounds and the gap before each segment."""
    long_gap = F.max(F.when(F.col("gap") > GAP_US, F.col("gap")))
    return in_segments(spark, sf_dir).groupBy("symbol", F.col("segment").cast("bigint").alias("segment")).agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), long_gap.alias("gap_before"))


@query("""
    SELECT symbol, sum(CASE WHEN us <= p THEN 1 ELSE 0 END) = 0 AS strictly_rising FROM (SELECT symbol, us, lag(us) OVER (PARTITION BY symbol ORDER BY event_id) AS p FROM ticks) q GROUP BY symbol""")
def causality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each symbol's times rise with its ids."""
    rows = scans.previous(projection(spark, sf_dir, "ticks"), ["symbol"], ["event_id"], scans.span("event_id", ARRIVALS), p="us")
    return rows.groupBy("symbol").agg((total(F.col("us") <= F.col("p")) == 0).alias("strictly_rising"))


@query("""
    WITH g AS (SELECT symbol, us, mid, CASE WHEN us - lag(us) OVER (PARTITION BY symbol ORDER BY us) > 7200000000 THEN 1 ELSE 0 END AS fresh FROM ticks),
    s AS (SELECT symbol, us, mid, sum(fresh) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT symbol, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n, round(avg(mid), 6) AS mean_mid FROM s GROUP BY symbol, k""")
def session_gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of quotes at most two hours apart."""
    rows = scans.segments(projection(spark, sf_dir, "ticks").select("symbol", "us", "mid"), ["symbol"], "us", ["us"], GAP_US, scans.span("us", DAY_US))
    return rows.groupBy("symbol", "segment").agg(F.min("us").alias("start_us"), (F.max("us") + GAP_US).alias("end_us"), F.count("*").alias("n"), F.round(F.avg("mid"), 6).alias("mean_mid")).drop("segment")


@query(f"""
    WITH a AS (SELECT symbol, us, mid, spread, lag(mid) OVER (PARTITION BY symbol ORDER BY us) AS pm, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS pu, row_number() OVER (PARTITION BY symbol ORDER BY us) AS rn FROM ticks),
    b AS (SELECT *, CASE WHEN pm IS NULL THEN NULL ELSE (mid - pm) / pm END AS r, coalesce((mid - pm) / ((us - pu) / 1e6), 0e0) AS velocity FROM a),
    c AS (SELECT *, CASE WHEN pu IS NULL THEN 0e0 ELSE (velocity - lag(velocity) OVER (PARTITION BY symbol ORDER BY us)) / ((us - pu) / 1e6) END AS acceleration,
      stddev_pop(r) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS sd, count(r) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS nr,
      first_value(mid) OVER {_W} AS m0, max(mid) OVER {_W} AS hi, min(mid) OVER {_W} AS lo, avg(spread) OVER {_W} AS ms, first_value(us) OVER {_W} AS u0, count(*) OVER {_W} AS k,
      sum(CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS signs,
      sum(CASE WHEN r <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS moves FROM b)
    SELECT symbol, us, round(coalesce(r, 0e0), 6) AS return_1, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(mid - m0, 6) AS momentum, round(CASE WHEN nr >= 2 THEN sd WHEN nr = 1 THEN abs(r) ELSE 0e0 END, 5) AS volatility,
      round(hi - lo, 6) AS rolling_range, round(spread - ms, 6) AS spread_expansion, round(coalesce((k - 1) / nullif((us - u0) / 1e6, 0), 0e0), 6) AS tick_frequency,
      round(coalesce(((us - u0) / 1e6 / nullif(k - 1, 0)) / ((us - pu) / 1e6), 0e0), 6) AS burst, round(coalesce(abs(signs) * 1e0 / nullif(moves, 0), 0e0), 6) AS direction_persistence,
      round(CASE WHEN hi > lo THEN (mid - lo) / (hi - lo) ELSE 5e-1 END, 6) AS range_position, CAST(least(rn, 120) AS bigint) AS tick_count FROM c""")
def tick_features_w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each tick over the last 20; buckets see the 120 ticks before them. Ticks of one instant go by their values."""
    rows = projection(spark, sf_dir, "ticks").select("symbol", "us", "mid", "spread")
    ties = ["us", "mid", "spread"]
    line = scans.line(["symbol"], ties)
    window, returns = line.rowsBetween(-19, 0), line.rowsBetween(-18, 0)
    c, zero = F.col, F.lit(0.0)
    seconds = (c("us") - c("pu")) / 1e6
    seen = scans.with_context(rows, ["symbol"], ties, scans.span("us", DAY_US), tail=120)
    seen = seen.withColumns({"pm": F.lag("mid").over(line), "pu": F.lag("us").over(line), "rn": F.row_number().over(line)})
    seen = seen.withColumns({"r": over(c("mid") - c("pm"), c("pm")), "velocity": F.coalesce(over(c("mid") - c("pm"), seconds), zero)})
    seen = seen.withColumns({
        "acceleration": F.when(c("pu").isNull(), zero).otherwise(over(c("velocity") - F.lag("velocity").over(line), seconds)),
        "sd": F.stddev_pop("r").over(returns), "nr": F.count("r").over(returns), "m0": F.first("mid").over(window), "hi": F.max("mid").over(window), "lo": F.min("mid").over(window), "ms": F.avg("spread").over(window), "u0": F.first("us").over(window), "k": F.count("*").over(window),
        "signs": F.sum(F.coalesce(F.signum("r"), zero)).over(returns), "moves": F.sum(F.when(c("r") != 0, 1).otherwise(0)).over(returns),
    })
    span = (c("us") - c("u0")) / 1e6
    found = {
        "return_1": F.coalesce("r", zero), "velocity": c("velocity"), "acceleration": c("acceleration"), "momentum": c("mid") - c("m0"), "volatility": F.when(c("nr") >= 2, c("sd")).when(c("nr") == 1, F.abs("r")).otherwise(zero), "rolling_range": c("hi") - c("lo"),
        "spread_expansion": c("spread") - c("ms"), "tick_frequency": F.coalesce((c("k") - 1) / F.nullif(span, zero), zero), "burst": F.coalesce(over(span / F.nullif(c("k") - 1, F.lit(0)), seconds), zero),
        "direction_persistence": F.coalesce(F.abs("signs") / F.nullif(c("moves"), F.lit(0)), zero), "range_position": F.when(c("hi") > c("lo"), (c("mid") - c("lo")) / (c("hi") - c("lo"))).otherwise(0.5),
    }
    digits = {"volatility": 5}
    return scans.without_context(seen).select("symbol", "us", *[F.round(v, digits.get(n, 6)).alias(n) for n, v in found.items()], F.least("rn", F.lit(120)).cast("bigint").alias("tick_count"))


@query("""
    WITH c AS (SELECT strategy, trade_id, us, pnl, sum(pnl) OVER (PARTITION BY strategy ORDER BY us, trade_id, pnl, volume ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity, row_number() OVER (PARTITION BY strategy ORDER BY us, trade_id, pnl, volume) AS rn FROM trades),
    p AS (SELECT *, greatest(0e0, max(equity) OVER (PARTITION BY strategy ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM c)
    SELECT strategy, round(max(peak - equity), 4) AS drawdown, round(max((peak + 1e6 - equity - 1e6) / (peak + 1e6)), 6) AS relative_drawdown FROM p GROUP BY strategy""")
def running_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest fall of each strategy's equity below its peak, also as a share of a starting balance."""
    rows = scans.equity_curve(projection(spark, sf_dir, "trades"), ["strategy"], TRADES, scans.span("us", 30 * DAY_US), "pnl")
    fall = F.col("peak") - F.col("equity")
    return rows.groupBy("strategy").agg(F.round(F.max(fall), 4).alias("drawdown"), F.round(F.max(fall / (F.col("peak") + 1e6)), 6).alias("relative_drawdown"))


@query("""
    WITH ordered AS (SELECT *, lag(pnl) OVER (PARTITION BY strategy ORDER BY us, trade_id, pnl, volume) AS before_pnl FROM trades)
    SELECT strategy, count(*) AS n, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS bigint) AS wins, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS bigint) AS losses, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0e0 END), 0), 6) AS profit_factor,
      round(avg(pnl), 4) AS expectancy, CAST(sum(CASE WHEN before_pnl > 0 AND pnl < 0 THEN 1 ELSE 0 END) AS bigint) AS flips, round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) AS sharpe_like FROM ordered GROUP BY strategy""")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, losses and turns from profit to loss of each strategy."""
    pnl = F.col("pnl")
    rows = scans.previous(projection(spark, sf_dir, "trades"), ["strategy"], TRADES, scans.span("us", 30 * DAY_US), before_pnl="pnl")
    won, lost = F.sum(F.greatest(pnl, F.lit(0.0))), F.sum(F.greatest(-pnl, F.lit(0.0)))
    return rows.groupBy("strategy").agg(
        F.count("*").alias("n"), total(pnl > 0).alias("wins"), total(pnl < 0).alias("losses"), F.round(won / F.nullif(lost, F.lit(0.0)), 6).alias("profit_factor"), F.round(F.avg(pnl), 4).alias("expectancy"),
        total((F.col("before_pnl") > 0) & (pnl < 0)).alias("flips"), F.round(F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0)), 6).alias("sharpe_like"),
    )


@query("""
    SELECT event_id, count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM ticks""")
def rate_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a symbol the hour up to each event has."""
    return scans.within(projection(spark, sf_dir, "ticks").select("event_id", "symbol", "us"), ["symbol"], "us", 3_600_000_000, "recent").select("event_id", "recent")


@query("""
    SELECT split, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT us, CASE WHEN rn <= n / 2 THEN 'development' WHEN rn <= n * 3 / 4 THEN 'validation' ELSE 'unseen' END AS split FROM (SELECT us, row_number() OVER (ORDER BY us) AS rn, count(*) OVER () AS n FROM bars_days) q) s GROUP BY split""".replace("bars_days", "(SELECT DISTINCT day_us AS us FROM bars) d"))
def chronological_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by place: the first half, the next quarter, the rest."""
    days = order.positioned(projection(spark, sf_dir, "bars").select(F.col("day_us").alias("us")).distinct(), ["us"])
    n, at = days.count(), F.col("position") + 1
    split = F.when(at <= n / 2, "development").when(at <= n * 3 / 4, "validation").otherwise("unseen")
    return days.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("""
    WITH s AS (SELECT symbol, us - us % 86400000000 AS day_us, min(us) AS a, max(us) AS b FROM ticks GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY a, symbol) - 1 AS i, count(*) OVER () AS n FROM s),
    c AS (SELECT max(CASE WHEN i = CAST(floor(n / 2e0) AS bigint) THEN a END) AS c1, max(CASE WHEN i = CAST(floor(3 * n / 4e0) AS bigint) THEN a END) AS c2 FROM o)
    SELECT CASE WHEN b < c1 - 60000000 THEN 'development' WHEN a >= c1 + 60000000 AND b < c2 - 60000000 THEN 'validation' WHEN a >= c2 + 60000000 THEN 'unseen' ELSE 'guard' END AS part, count(*) AS segments FROM s CROSS JOIN c GROUP BY 1""")
def partition_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a symbol by the borders at half and three quarters of all of them, those at a border apart."""
    days = projection(spark, sf_dir, "ticks").groupBy("symbol", (F.col("us") - F.col("us") % DAY_US).alias("day_us")).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    placed = order.positioned(days, ["a", "symbol"])
    n = placed.count()
    borders = dict(placed.where(F.col("position").isin(n // 2, 3 * n // 4)).select("position", "a").collect())
    c1, c2 = borders.get(n // 2), borders.get(3 * n // 4)
    a, b = F.col("a"), F.col("b")
    part = F.when(b < F.lit(c1) - GUARD_US, "development").when((a >= F.lit(c1) + GUARD_US) & (b < F.lit(c2) - GUARD_US), "validation").when(a >= F.lit(c2) + GUARD_US, "unseen").otherwise("guard")
    return placed.groupBy(part.alias("part")).agg(F.count("*").alias("segments"))


@query("SELECT strategy, session, @d(pnl, 0.5) AS p50, @d(pnl, 0.9) AS p90, @d(pnl, 0.95) AS p95, @d(pnl, 0.99) AS p99 FROM trades GROUP BY strategy, session")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each strategy and session at four ranks."""
    return quantiles.exact(projection(spark, sf_dir, "trades"), ["strategy", "session"], "pnl", {f"p{round(100 * p)}": nearest(p) for p in (0.5, 0.9, 0.95, 0.99)})


@query("SELECT strategy, round(@p(pnl, 0.05), 6) AS p05, round(@p(pnl, 0.25), 6) AS p25, round(@p(pnl, 0.75), 6) AS p75, round(@p(pnl, 0.95), 6) AS p95, round(median(pnl), 6) AS median FROM trades GROUP BY strategy")
def inclusive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each strategy between the places around a share of them."""
    wanted = {"p05": linear(0.05), "p25": linear(0.25), "p75": linear(0.75), "p95": linear(0.95), "median": linear(0.5)}
    return quantiles.exact(projection(spark, sf_dir, "trades"), ["strategy"], "pnl", wanted).select("strategy", *[F.round(c, 6).alias(c) for c in wanted])


@query("""
    SELECT strategy, session, max(CASE WHEN rn = div_n + 1 THEN pnl END) AS upper_median FROM (
      SELECT strategy, session, pnl, row_number() OVER (PARTITION BY strategy, session ORDER BY pnl, trade_id) AS rn, CAST(floor(count(*) OVER (PARTITION BY strategy, session) / 2e0) AS bigint) AS div_n FROM trades) q GROUP BY strategy, session""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the middle results of each strategy and session."""
    return quantiles.exact(projection(spark, sf_dir, "trades"), ["strategy", "session"], "pnl", {"upper_median": UPPER})


@query("""
    SELECT horizon, count(*) AS n, CAST(sum(CASE WHEN state = 'O' THEN 1 ELSE 0 END) AS bigint) AS pending, CAST(sum(CASE WHEN state = 'F' THEN 1 ELSE 0 END) AS bigint) AS complete, round(avg(cost), 4) AS mean_cost,
      round(@d(cost, 0.5), 6) AS median_cost, round(1e2 * sum(CASE WHEN cost > 0 THEN 1 ELSE 0 END) / count(*), 6) AS positive, round(1e2 * sum(CASE WHEN cost < 0 THEN 1 ELSE 0 END) / count(*), 6) AS negative,
      round(1e2 * sum(CASE WHEN cost = 0 THEN 1 ELSE 0 END) / count(*), 6) AS flat FROM evals GROUP BY horizon""")
def horizon_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and costs by horizon."""
    rows, cost = projection(spark, sf_dir, "evals"), F.col("cost")
    share = lambda test: F.round(100 * total(test) / F.count("*"), 6)
    counts = rows.groupBy("horizon").agg(
        F.count("*").alias("n"), total(F.col("state") == "O").alias("pending"), total(F.col("state") == "F").alias("complete"), F.round(F.avg(cost), 4).alias("mean_cost"),
        share(cost > 0).alias("positive"), share(cost < 0).alias("negative"), share(cost == 0).alias("flat"),
    )
    middle = quantiles.exact(rows, ["horizon"], "cost", {"median_cost": nearest(0.5)})
    return counts.join(middle, "horizon", "left").withColumn("median_cost", F.round("median_cost", 6))


@query("""
    SELECT r.status, e.flag, count(*) AS n, round(avg(cost), 4) AS mean_cost, round(@d(cost, 0.5), 6) AS median_cost, round(@d(cost, 0.9), 6) AS p90, round(@d(cost, 0.95), 6) AS p95,
      round(avg(CASE WHEN cost > 0 THEN 1e0 ELSE 0e0 END), 6) AS better FROM runs r JOIN evals e ON r.decision_id = e.decision_id GROUP BY r.status, e.flag""")
def outcomes_by_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by the status of the run and the flag of its evaluation."""
    runs, evals = projection(spark, sf_dir, "runs").select("decision_id", "status"), projection(spark, sf_dir, "evals").select("decision_id", "flag", "cost")
    rows, by = stored(runs.join(evals, "decision_id").select("status", "flag", "cost")), ["status", "flag"]  # quantiles read them in many passes
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("mean_cost"), F.round(F.avg(F.when(F.col("cost") > 0, 1.0).otherwise(0.0)), 6).alias("better"))
    ranks = {"median_cost": nearest(0.5), "p90": nearest(0.9), "p95": nearest(0.95)}
    return counts.join(quantiles.exact(rows, by, "cost", ranks), by, "left").withColumns({c: F.round(c, 6) for c in ranks})


@query("""
    WITH g AS (SELECT symbol, us - us % 86400000000 AS day_us, min(us) AS first_us FROM ticks GROUP BY 1, 2), k AS (SELECT symbol, day_us, row_number() OVER (ORDER BY first_us, symbol) AS rn, count(*) OVER () AS n FROM g)
    SELECT symbol, day_us, CASE WHEN rn <= floor(n * 70 / 1e2) THEN 'train' WHEN rn <= floor(n * 85 / 1e2) THEN 'validation' ELSE 'test' END AS split FROM k""")
def chronological_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a symbol by the place of their first tick: 70, 15 and 15 of a hundred."""
    days = projection(spark, sf_dir, "ticks").groupBy("symbol", (F.col("us") - F.col("us") % DAY_US).alias("day_us")).agg(F.min("us").alias("first_us"))
    placed = order.positioned(days, ["first_us", "symbol"])
    n, at = placed.count(), F.col("position") + 1
    split = F.when(at <= n * 70 // 100, "train").when(at <= n * 85 // 100, "validation").otherwise("test")
    return placed.select("symbol", "day_us", split.alias("split"))
