"""Reports and gates over results. Each oracle states its report in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.operators.asof import asof
from tidemark.plans.registry import projection, query
from tidemark.session import table


@query("""
    WITH t AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day_us) AS c FROM bars), r AS (SELECT *, CASE WHEN c IS NULL THEN high - low WHEN abs(high - c) > high - low AND abs(high - c) >= abs(low - c) THEN abs(high - c) WHEN abs(low - c) > high - low THEN abs(low - c) ELSE high - low END AS tr FROM t),
    g AS (SELECT symbol, count(*) AS n, max(high) AS high, min(low) AS low, avg(tr) AS atr, arg_min(open, day_us) AS o, arg_max(close, day_us) AS c FROM r GROUP BY symbol)
    SELECT symbol, n, round(high, 6) AS high, round(low, 6) AS low, round(atr, 6) AS atr, round((c - o) / o, 6) AS return_over_bars, round((high - low) / o, 6) AS range_pct, round((c - low) / (high - low), 6) AS close_position, CASE sign(c - o) WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM g""")
def timeframe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each symbol's bars, with the mean true range of the series."""
    out = reports.candles(projection(spark, sf_dir, "bars"), ["symbol"], "day_us")
    return out.select("symbol", "n", *[F.round(c, 6).alias(c) for c in ("high", "low", "atr", "return_over_bars", "range_pct", "close_position")], "direction")


@query("""
    WITH l AS (SELECT event_id, us + 7200000000 AS us FROM ticks), d AS (SELECT event_id, us // 86400000000 AS day, us % 86400000000 // 60000000 AS m FROM l)
    SELECT event_id, CASE WHEN day < 19724 OR day > 19748 THEN 'UNKNOWN' WHEN day = 19731 THEN 'CLOSED' WHEN day = 19733 THEN CASE WHEN m >= 600 AND m < 720 THEN 'OPEN' ELSE 'CLOSED' END WHEN (day + 3) % 7 < 4 AND ((m >= 60 AND m < 600) OR (m >= 660 AND m < 1380)) THEN 'OPEN' WHEN (day + 3) % 7 = 4 AND m < 1200 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM d""")
def calendar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a broker's market is open at each tick: local sessions, holidays and single days."""
    weekly = {d: [(60, 600), (660, 1380)] for d in range(4)} | {4: [(0, 1200)]}
    rows = projection(spark, sf_dir, "ticks").select("event_id", "us")
    return reports.calendar_status(rows, "us", "Etc/GMT-2", weekly, ["2024-01-09"], {"2024-01-11": [(600, 720)]}, ("2024-01-02", "2024-01-26")).select("event_id", "status")


@query("""
    SELECT trade_id, CASE WHEN volume < 5 THEN 0.3 ELSE CAST(floor(CAST(least(volume, 40) AS decimal(20, 8)) * 10 / 3) * 3 / 10 AS double) END AS lots,
      CASE WHEN trade_id % 5 = 0 THEN 'DIRECTION' WHEN trade_id % 5 < 3 AND (pnl >= 0 OR -pnl < 50) THEN 'STOP_LOSS' WHEN trade_id % 5 >= 3 AND (pnl <= 0 OR pnl < 50) THEN 'STOP_LOSS' WHEN volume < 20 THEN 'TAKE_PROFIT' END AS fault
    FROM (SELECT trade_id, pnl, CASE WHEN volume < 5 THEN 1e-1 ELSE volume END AS volume FROM trades) t""")
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as a broker takes them, and what is wrong with stop levels."""
    rows = projection(spark, sf_dir, "trades").withColumn("volume", F.when(F.col("volume") < 5, 0.1).otherwise(F.col("volume")))
    k, entry = F.col("trade_id") % 5, F.lit(1e7)
    side = F.when(k == 0, "FLAT").when(k < 3, "LONG").otherwise("SHORT")
    sign = F.when(k < 3, 1).otherwise(-1)
    fault = reports.stop_fault(side, entry, entry + F.col("pnl"), entry + sign * 2.5 * F.col("volume"), F.lit(50.0))
    return rows.select("trade_id", reports.lots(F.col("volume"), "0.25", "50", "0.3", "40").alias("lots"), fault.alias("fault"))


_ORDER = "(PARTITION BY strategy, session ORDER BY us, trade_id, pnl, volume)"


@query(f"""
    WITH e AS (SELECT *, sum(pnl) OVER {_ORDER[:-1]} ROWS UNBOUNDED PRECEDING) AS equity, lag(pnl) OVER {_ORDER} AS b, row_number() OVER {_ORDER} AS rn FROM trades),
    p AS (SELECT *, max(equity) OVER (PARTITION BY strategy, session ORDER BY rn ROWS UNBOUNDED PRECEDING) AS top FROM e)
    SELECT strategy, session, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, round(sum(pnl) / count(*), 4) AS expectancy, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 6) AS profit_factor, round(max(CASE WHEN top > 0 THEN top ELSE 0 END - equity), 4) AS max_drawdown,
      count(*) FILTER (WHERE b > 0 AND pnl < 0) AS flips, round(count(*) * 3600000000 / (max(us) - min(us)), 6) AS trades_per_hour, round(avg(pnl) / stddev_pop(pnl) * sqrt(count(*)), 6) AS sharpe_like FROM p GROUP BY strategy, session""")
def trade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each strategy and session."""
    out = reports.trade_report(projection(spark, sf_dir, "trades"), ["strategy", "session"], ["us", "trade_id", "pnl", "volume"])
    digits = {"expectancy": 4, "profit_factor": 6, "max_drawdown": 4, "trades_per_hour": 6, "sharpe_like": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


_WINDOWS = "w AS (SELECT strategy, trade_id % 4 AS k, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, avg(pnl) AS e, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS pf, max(-pnl) AS dd, median(volume) AS med, sum(pnl) / nullif(sum(abs(pnl)), 0) AS cap FROM trades GROUP BY 1, 2)"


@query(f"""
    WITH {_WINDOWS}, m AS (SELECT strategy, med, row_number() OVER (PARTITION BY strategy ORDER BY med) AS rn FROM w)
    SELECT w.strategy, CAST(sum(trades) AS bigint) AS trades, CAST(sum(wins) AS bigint) AS wins, round(sum(e * trades) / sum(trades), 4) AS expectancy, round(min(pf), 6) AS profit_factor, round(max(dd), 4) AS max_drawdown, max((SELECT m.med FROM m WHERE m.strategy = w.strategy AND rn = 3)) AS median_s, round(avg(cap), 6) AS capture FROM w GROUP BY w.strategy""")
def replay_report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of four windows of each strategy as one."""
    won, lost = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    windows = projection(spark, sf_dir, "trades").groupBy("strategy", (F.col("trade_id") % 4).alias("k")).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.avg("pnl").alias("expectancy"), (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), F.max(-F.col("pnl")).alias("max_drawdown"),
        F.percentile("volume", F.lit(0.5)).alias("median_s"), (F.sum("pnl") / F.nullif(F.sum(F.abs("pnl")), F.lit(0.0))).alias("capture"),
    )
    out = reports.merged_reports(windows, ["strategy"])
    return out.withColumns({c: F.round(c, n) for c, n in {"expectancy": 4, "profit_factor": 6, "max_drawdown": 4, "capture": 6}.items()})


@query("""
    WITH d AS (SELECT strategy, us // 86400000000 AS day, sum(pnl) / 20000 AS share FROM trades GROUP BY 1, 2), a AS (SELECT strategy, max(share) AS best, min(share) AS worst, count(*) FILTER (WHERE share >= 0.1) AS big FROM d GROUP BY 1)
    SELECT t.strategy, count(*) AS trades, round(sum(pnl) / 20000, 6) AS total_return, round(max(best), 6) AS best_day, round(max(worst), 6) AS worst_day, max(big) AS days_of_ten_percent, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 6) AS profit_factor, round(count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate FROM trades t JOIN a ON a.strategy = t.strategy GROUP BY t.strategy""")
def account_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of each strategy's account."""
    rows = projection(spark, sf_dir, "trades").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    out = reports.account_report(rows, ["strategy"], "day", 20_000.0)
    return out.withColumns({c: F.round(c, 6) for c in ("total_return", "best_day", "worst_day", "profit_factor", "win_rate")})


@query("""
    WITH s AS (SELECT symbol AS candidate, trade_id % 10 % 3 AS s, count(*) AS n, avg(pnl) AS e, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS pf, max(-pnl) AS dd FROM trades WHERE NOT (symbol % 7 = 3 AND trade_id % 10 % 3 = 2) GROUP BY 1, 2),
    c AS (SELECT candidate, max(CASE WHEN s = 0 THEN n END) AS n0, max(CASE WHEN s = 1 THEN n END) AS n1, max(CASE WHEN s = 2 THEN n END) AS n2, min(CASE WHEN s > 0 THEN coalesce(e, 0) END) AS e, min(CASE WHEN s > 0 THEN coalesce(pf, 0) END) AS pf, max(CASE WHEN s > 0 THEN coalesce(dd, 0) END) AS dd FROM s GROUP BY 1),
    r AS (SELECT candidate, list_filter([CASE WHEN n0 IS NULL OR n1 IS NULL OR n2 IS NULL THEN 'MISSING_STAGE:' || array_to_string(list_filter([CASE WHEN n0 IS NULL THEN 'DEVELOPMENT' END, CASE WHEN n1 IS NULL THEN 'VALIDATION' END, CASE WHEN n2 IS NULL THEN 'UNSEEN_HOLDOUT' END], lambda x: x IS NOT NULL), ',') END,
      CASE WHEN coalesce(n0, 0) < 150 THEN 'INSUFFICIENT_EVIDENCE:DEVELOPMENT' END, CASE WHEN candidate % 5 = 4 OR n0 IS NULL THEN 'SAFETY_REGRESSION:DEVELOPMENT' END, CASE WHEN coalesce(n1, 0) < 150 THEN 'INSUFFICIENT_EVIDENCE:VALIDATION' END, CASE WHEN candidate % 5 = 4 OR n1 IS NULL THEN 'SAFETY_REGRESSION:VALIDATION' END,
      CASE WHEN coalesce(n2, 0) < 150 THEN 'INSUFFICIENT_EVIDENCE:UNSEEN_HOLDOUT' END, CASE WHEN candidate % 5 = 4 OR n2 IS NULL THEN 'SAFETY_REGRESSION:UNSEEN_HOLDOUT' END], lambda x: x IS NOT NULL) AS a, list_filter([CASE WHEN e <= 1 THEN 'EXPECTANCY_NOT_IMPROVED' END, CASE WHEN pf < 1 THEN 'PROFIT_FACTOR_REGRESSION' END, CASE WHEN dd > 4900 THEN 'DRAWDOWN_REGRESSION' END], lambda x: x IS NOT NULL) AS b FROM c)
    SELECT candidate, CASE WHEN array_to_string(a, ',') LIKE '%INSUFFICIENT%' THEN 'INSUFFICIENT_EVIDENCE' WHEN len(a) + len(b) > 0 THEN 'REJECTED' ELSE 'PROMOTE_TO_SHADOW' END AS status, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ';') AS reasons FROM r""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether candidates may be promoted, by their worst later stage."""
    won, lost = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    k = F.col("trade_id") % 10 % 3
    rows = projection(spark, sf_dir, "trades").withColumn("stage", F.when(k == 0, reports.STAGES[0]).when(k == 1, reports.STAGES[1]).otherwise(reports.STAGES[2])).where("not (symbol % 7 = 3 and stage = 'UNSEEN_HOLDOUT')")
    stages = rows.groupBy(F.col("symbol").alias("candidate"), "stage").agg(F.count("*").alias("trades"), F.avg("pnl").alias("expectancy"), (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), F.max(-F.col("pnl")).alias("max_drawdown"))
    out = reports.promotion(stages.withColumn("leak", F.col("candidate") % 5 == 4), {"expectancy": 1.0, "profit_factor": 1.0, "max_drawdown": 4900.0}, 150)
    return out.select("candidate", "status", F.array_join("reasons", ";").alias("reasons"))


@query("""
    SELECT decision_id, CASE WHEN bool_and(cost <= 1e-9) THEN 'CONSISTENT_HOLD' WHEN sum(CAST(cost > 1e-9 AS int)) <= 2 THEN 'TRANSIENT_MISS' WHEN sum(CAST(cost >= 500 AS int)) >= 3 THEN 'STRONG_PERSISTENT_MISS' ELSE 'PERSISTENT_DIRECTIONAL_MISS' END AS class FROM evals WHERE cost IS NOT NULL GROUP BY decision_id HAVING count(*) = 4""")
def cross_horizon_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How lasting missed moves are, of decisions with costs at four horizons."""
    return reports.cross_horizon(projection(spark, sf_dir, "evals"), "decision_id", "cost", strong=500.0)


@query("""
    WITH s AS (SELECT user_id % 10 AS symbol, CASE user_id % 10 % 4 WHEN 0 THEN 7200 WHEN 1 THEN 5400 WHEN 2 THEN 100000 ELSE 7200 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3600 END END AS r FROM events),
    x AS (SELECT symbol, o, bool_and(abs(r - o) <= 1800) AS fits, bool_or(abs(r - o) <= 1800) AS any_fit FROM s CROSS JOIN (SELECT unnest([0, 3600, 7200, 10800]) AS o) c GROUP BY 1, 2)
    SELECT symbol, CASE count(*) FILTER (WHERE fits) WHEN 1 THEN 'CALIBRATED' ELSE CASE WHEN bool_or(any_fit) THEN 'AMBIGUOUS' ELSE 'STALE_MARKET' END END AS status, CASE count(*) FILTER (WHERE fits) WHEN 1 THEN max(o) FILTER (WHERE fits) END AS offset_s FROM x GROUP BY symbol""")
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one offset of each symbol's clock that fits all samples."""
    k = F.col("user_id") % 10
    residual = F.when(k % 4 == 0, 7200).when(k % 4 == 1, 5400).when(k % 4 == 2, 100_000).otherwise(F.when(F.col("event_id") % 2 == 0, 7200).otherwise(10_800))
    return reports.clock_offsets(table(spark, sf_dir, "events").withColumn("symbol", k), "symbol", residual, [0, 3600, 7200, 10800], 1800)


@query("""
    SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 7 = 0 THEN 'CASE_FINGERPRINT_MISMATCH' WHEN o_orderkey % 11 = 0 THEN 'CONFIGURATION_FINGERPRINT_MISMATCH' WHEN o_orderstatus <> 'F' THEN 'REPLAY_STATUS_MISMATCH' END AS reason,
      CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN round(o_totalprice / 2, 4) END AS elapsed_delta, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_custkey END AS calls_delta FROM orders""")
def benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two runs of each case, only where both are of the same case and configuration."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    run = lambda case, config, scale: rows.select(k.alias("case_id"), case.alias("case_hash"), config.alias("config_hash"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("PARTIAL").alias("status"), (F.col("o_totalprice") * scale).alias("elapsed"), (F.col("o_custkey") * (2 * scale).cast("int")).alias("calls"))
    out = reports.compared(run(k, F.lit(1), F.lit(0.5)), run(F.when(k % 7 == 0, None).otherwise(k), F.when(k % 11 == 0, 2).otherwise(1), F.lit(1.0)), "case_id", ["elapsed", "calls"])
    return out.withColumn("elapsed_delta", F.round("elapsed_delta", 4))


@query("""
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'SCHEMA_INVALID' WHEN event_id % 9 = 0 THEN 'QUOTE_INVALID' END AS fault, CASE WHEN event_id % 13 = 0 THEN 21 ELSE 17 + CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END - 1 END AS missing,
      CASE WHEN event_id % 13 <> 0 THEN event_id % 7 / 1e0 END AS m1_range, CASE WHEN event_id % 13 <> 0 THEN [1e0, -1e0, 0e0, NULL][event_id % 4 + 1] END AS m1_direction, round(sin(2 * pi() * (us % 86400000000) / 864e8), 6) AS hour_sin FROM ticks""")
def market_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of 23 values out of snapshots, with what they lack."""
    k = F.col("event_id")
    direction = F.element_at(F.array(*[F.lit(x) for x in ("up", "DOWN", "FLAT", "INSUFFICIENT_DATA")]), (k % 4 + 1).cast("int"))
    body = F.format_string('{"point": 0.01, "quote": {"bid": 100, "ask": 101, "spread_points": %d}, "features": {"M1": {"return_over_bars": 0.5, "range_pct": %d, "direction": "%s"}, "H1": {"close_position": 0.25}}}', F.when(k % 9 == 0, 50).otherwise(100), k % 7, direction)
    rows = projection(spark, sf_dir, "ticks").select(k, "us", F.when(k % 13 == 0, "damaged").otherwise(body).alias("j"))
    out = reports.market_vector(rows, "j", "us")
    return out.select("event_id", "fault", "missing", F.get("values", F.lit(2)).alias("m1_range"), F.get("values", F.lit(5)).alias("m1_direction"), F.round(F.get("values", F.lit(21)), 6).alias("hour_sin"))


@query("""
    WITH d AS (SELECT event_id AS decision_id, symbol, us + 60000000 AS done_us FROM ticks WHERE event_type = 'purchase'), q AS (SELECT symbol, us AS q_us, bid FROM ticks WHERE bid > 0 AND ask >= bid)
    SELECT decision_id, CASE WHEN q_us IS NULL OR q_us > done_us + 3600000000 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status, CASE WHEN q_us <= done_us + 3600000000 THEN q_us - done_us END AS delay_us FROM d ASOF LEFT JOIN q ON d.symbol = q.symbol AND d.done_us <= q.q_us""")
def reference_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote that isn't before a decision's completion, within an hour."""
    ticks = projection(spark, sf_dir, "ticks")
    decided = ticks.where("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), "symbol", (F.col("us") + 60_000_000).alias("done_us"))
    out = asof(decided, ticks.where("bid > 0 and ask >= bid").select("symbol", "us", "bid"), "symbol", "done_us", "us", ["bid"], 3_600_000_000, forward=True)
    return out.select("decision_id", F.when(F.col("q_us").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("status"), (F.col("q_us") - F.col("done_us")).alias("delay_us"))
