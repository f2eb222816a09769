"""Point-in-time joins: as-of quotes, excursions and the evaluation of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof, in_ranges
from tidemark.operators.outcomes import evaluate_outcomes
from tidemark.plans.registry import projection, query, statement

HOUR = 3_600_000_000


@query("""
    SELECT d.decision_id, t.us AS q_us, t.bid AS q_bid, t.ask AS q_ask FROM (SELECT *, us + 1 AS probe_us FROM decisions) d ASOF LEFT JOIN ticks t ON d.symbol = t.symbol AND d.probe_us <= t.us
    QUALIFY true""".replace("QUALIFY true", "").replace("t.us AS q_us, t.bid AS q_bid, t.ask AS q_ask", "CASE WHEN t.us - d.probe_us <= 3600000000 THEN t.us END AS q_us, CASE WHEN t.us - d.probe_us <= 3600000000 THEN t.bid END AS q_bid, CASE WHEN t.us - d.probe_us <= 3600000000 THEN t.ask END AS q_ask"))
def asof_forward_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote strictly after each decision, within an hour."""
    decisions, ticks = projection(spark, sf_dir, "decisions"), projection(spark, sf_dir, "ticks")
    probes = decisions.select("decision_id", "symbol", (F.col("us") + 1).alias("probe_us"))
    return asof(probes, ticks, "symbol", "probe_us", "us", ["bid", "ask"], HOUR).select("decision_id", "q_us", "q_bid", "q_ask")


@query("""
    SELECT d.decision_id, CASE WHEN d.probe_us - t.us <= 3600000000 THEN t.us END AS q_us, CASE WHEN d.probe_us - t.us <= 3600000000 THEN t.mid END AS q_mid
    FROM (SELECT *, us - 1 AS probe_us FROM decisions) d ASOF LEFT JOIN ticks t ON d.symbol = t.symbol AND d.probe_us >= t.us""")
def asof_backward_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote strictly before each decision, at most an hour old."""
    decisions, ticks = projection(spark, sf_dir, "decisions"), projection(spark, sf_dir, "ticks")
    probes = decisions.select("decision_id", "symbol", (F.col("us") - 1).alias("probe_us"))
    return asof(probes, ticks, "symbol", "probe_us", "us", ["mid"], HOUR, forward=False).select("decision_id", "q_us", "q_mid")


@query("""
    SELECT d.decision_id, count(*) AS n, round(max(t.bid) - min(d.ask), 6) AS mfe, round(min(t.bid) - min(d.ask), 6) AS mae FROM decisions d JOIN ticks t ON d.symbol = t.symbol AND t.us BETWEEN d.us AND d.us + 10800000000 GROUP BY d.decision_id""")
def excursion_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst of a long position over three hours from its entry."""
    decisions = projection(spark, sf_dir, "decisions").select("decision_id", "symbol", F.col("us").alias("lo"), (F.col("us") + 3 * HOUR).alias("hi"), F.col("ask").alias("entry"))
    ticks = projection(spark, sf_dir, "ticks").select("symbol", "us", "bid")
    path = in_ranges(decisions, ticks, "symbol", "lo", "hi", "us", 3 * HOUR)
    return path.groupBy("decision_id").agg(F.count("*").alias("n"), F.round(F.max("bid") - F.min("entry"), 6).alias("mfe"), F.round(F.min("bid") - F.min("entry"), 6).alias("mae"))


statement("horizon_cross", """
    SELECT decision_id, h.horizon, anchor_us + h.horizon * 1000000 AS target_us FROM decisions CROSS JOIN (SELECT CAST(3600 AS bigint) AS horizon UNION ALL SELECT 10800 UNION ALL SELECT 21600 UNION ALL SELECT 86400) h""")


@query("""
    WITH e AS (SELECT (SELECT max(us) FROM ticks) AS now_us),
    r AS (SELECT d.*, h.horizon, anchor_us + h.horizon * 1000000 AS target_us FROM decisions d CROSS JOIN (SELECT unnest([3600::bigint, 10800, 21600, 86400]) AS horizon) h),
    f AS (SELECT r.*, t.us AS f_us, t.bid AS f_bid, t.ask AS f_ask FROM r ASOF LEFT JOIN ticks t ON r.symbol = t.symbol AND r.target_us <= t.us),
    g AS (SELECT f.*, f_us - target_us <= 3600000000 AS near, CASE WHEN anchor_us IS NULL THEN 'INELIGIBLE' WHEN now_us < target_us + 3600000000 THEN 'PENDING' WHEN f_us IS NULL OR f_us - target_us > 3600000000 THEN 'DATA_UNAVAILABLE' ELSE 'COMPLETE' END AS status FROM f CROSS JOIN e),
    p AS (SELECT g.decision_id, g.horizon, max(t.bid) AS hi, min(t.bid) AS lo FROM g JOIN ticks t ON g.symbol = t.symbol AND t.us BETWEEN g.anchor_us AND g.target_us WHERE status = 'COMPLETE' GROUP BY 1, 2),
    q AS (SELECT g.*, hi, lo, CASE WHEN status = 'COMPLETE' THEN (f_bid - ask) / point END AS buy, CASE WHEN status = 'COMPLETE' THEN (bid - f_ask) / point END AS sell FROM g LEFT JOIN p ON g.decision_id = p.decision_id AND g.horizon = p.horizon)
    SELECT decision_id, CAST(horizon AS int) AS horizon, action, status, CASE WHEN status = 'COMPLETE' THEN f_us - target_us END AS lag_us, round(buy, 4) AS buy_points, round(sell, 4) AS sell_points,
      CASE WHEN status = 'COMPLETE' THEN CASE WHEN abs(buy - sell) < 1e-9 THEN 'TIE' WHEN buy > sell THEN 'BUY' ELSE 'SELL' END END AS best, round(CASE WHEN status = 'COMPLETE' AND action = 'HOLD' THEN greatest(0e0, buy, sell) END, 4) AS hold_cost,
      round(CASE WHEN status = 'COMPLETE' THEN greatest(hi, bid) - ask END, 4) AS buy_mfe, round(CASE WHEN status = 'COMPLETE' THEN least(lo, bid) - ask END, 4) AS buy_mae FROM q""")
def outcome_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions against all horizons as of the last quote."""
    decisions, ticks = projection(spark, sf_dir, "decisions"), projection(spark, sf_dir, "ticks")
    return evaluate_outcomes(decisions, ticks, ticks.agg(F.max("us")).first()[0] or 0)


# equi, semi, anti and composite joins
statement("evaluations_left_decisions", "SELECT e.decision_id, e.horizon, e.part, round(e.cost, 4) AS cost, r.status FROM evals e LEFT JOIN runs r ON e.decision_id = r.decision_id AND r.status <> 'PENDING'")
statement("exists_semi_join", "SELECT r.decision_id, r.status FROM runs r WHERE EXISTS (SELECT 1 FROM evals e WHERE e.decision_id = r.decision_id AND e.flag = 'R' AND e.cost > 0)")
statement("double_semi_join", "SELECT r.decision_id FROM runs r WHERE EXISTS (SELECT 1 FROM evals e WHERE e.decision_id = r.decision_id AND e.flag = 'R') AND EXISTS (SELECT 1 FROM evals e WHERE e.decision_id = r.decision_id AND e.flag = 'N')")
statement("orphan_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
statement("latest_run_per_agent", "SELECT agent, decision_id, status FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY us DESC, decision_id DESC) AS rn FROM runs) q WHERE rn = 1")


@query("SELECT a.decision_id, a.horizon, count(b.decision_id) AS later FROM evals a LEFT JOIN evals b ON a.decision_id = b.decision_id AND b.horizon = a.horizon + 1 GROUP BY a.decision_id, a.horizon")
def composite_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of the next horizon of each decision: rows of a horizon times those of the next, counted before they meet."""
    rows = projection(spark, sf_dir, "evals").select("decision_id", "horizon")
    counts = rows.repartition("decision_id").groupBy("decision_id", "horizon").agg(F.count("*").alias("n"))
    following = F.sum(F.when(F.col("decision_id").isNotNull() & F.col("horizon").isNotNull(), F.col("n"))).over(Window.partitionBy("decision_id").orderBy("horizon").rangeBetween(1, 1))
    return counts.select("decision_id", "horizon", (F.col("n") * F.coalesce(following, F.lit(0))).alias("later"))


statement("fill_chain", """
    SELECT o_orderkey, c_mktsegment, n_name, r_name, round(o_totalprice, 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'""")
statement("latest_run_scalar", "SELECT e.horizon, count(*) AS n FROM evals e JOIN runs r ON e.decision_id = r.decision_id WHERE r.us >= (SELECT max(us) - 86400000000 FROM runs) GROUP BY e.horizon")
statement("flag_by_exists", "SELECT s_suppkey, CASE WHEN k.l_suppkey IS NULL THEN false ELSE true END AS active FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49) k ON s_suppkey = k.l_suppkey")
statement("ambiguity_marked_join", """
    SELECT d.decision_id, r.status, count(*) OVER (PARTITION BY d.decision_id) > 1 AS ambiguous FROM decisions d LEFT JOIN evals e ON d.decision_id = e.decision_id LEFT JOIN runs r ON e.decision_id = r.decision_id""")
statement("prioritised_pairing", """
    SELECT decision_id, horizon, part FROM (SELECT r.decision_id, e.horizon, e.part, row_number() OVER (PARTITION BY r.decision_id ORDER BY CASE WHEN e.flag = 'R' THEN 0 WHEN e.state = 'F' THEN 1 ELSE 2 END, e.us DESC, e.part DESC, e.horizon) AS rn FROM runs r JOIN evals e ON r.decision_id = e.decision_id) q WHERE rn = 1""")
statement("suffix_rule_lookup", """
    SELECT p_partkey, benchmark FROM (SELECT p_partkey, b.benchmark, row_number() OVER (PARTITION BY p_partkey ORDER BY length(b.suffix) DESC) AS rn FROM part JOIN (SELECT '1' AS suffix, 'ONE' AS benchmark UNION ALL SELECT '11', 'ELEVEN' UNION ALL SELECT '3', 'THREE' UNION ALL SELECT '', 'DEFAULT') b ON p_brand LIKE '%' || b.suffix) q WHERE rn = 1""")
statement("adjacent_companions", """
    SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after_role, CAST(length(text) AS bigint) AS n FROM conversations""")
statement("opportunity_grid", "SELECT s.symbol, d.day_us, b.close IS NOT NULL AS traded FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT day_us FROM bars) d LEFT JOIN bars b ON b.symbol = s.symbol AND b.day_us = d.day_us")


@query("""
    WITH holes AS (SELECT symbol, day_us, CASE WHEN (day_us // 86400000000) % 3 = 0 THEN NULL ELSE close END AS close FROM bars)
    SELECT symbol, day_us, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM holes""")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price gaps filled forwards, then backwards."""
    from pyspark.sql import Window

    bars = projection(spark, sf_dir, "bars").select("symbol", "day_us", F.when(F.floor(F.col("day_us") / 86_400_000_000) % 3 != 0, F.col("close")).alias("close"))
    w = Window.partitionBy("symbol").orderBy("day_us")
    back = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("close", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return bars.select("symbol", "day_us", F.coalesce(back, ahead).alias("close"))


@query("""
    SELECT s.day_us, y.symbol, b.close, CASE WHEN b.close IS NULL THEN 'N/A: Not a trading day' ELSE 'OK' END AS note FROM (SELECT unnest(range((SELECT min(day_us) - 259200000000 FROM bars), (SELECT max(day_us) + 1 FROM bars), 86400000000)) AS day_us) s CROSS JOIN (SELECT DISTINCT symbol FROM bars) y LEFT JOIN bars b ON b.day_us = s.day_us AND b.symbol = y.symbol""")
def date_spine_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calendar day of the look-back for each symbol, traded or not."""
    bars = projection(spark, sf_dir, "bars")
    spine = bars.agg(F.explode(F.sequence(F.min("day_us") - 259_200_000_000, F.max("day_us"), F.lit(86_400_000_000))).alias("day_us"))
    days = spine.join(bars.select("symbol").distinct())  # each symbol has a row for each day
    return days.join(bars.select("day_us", "symbol", "close"), ["day_us", "symbol"], "left").withColumn("note", F.when(F.col("close").isNull(), "N/A: Not a trading day").otherwise("OK"))
