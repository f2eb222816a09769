"""Audits and dashboards: conditional counts, zero-filled grids, rates, quantiles and set logic.

Medians and percentiles follow five definitions that must not be mixed: nearest rank (``@d``), linear
(``@p``), true median, upper median, and the nineteenth of twenty linear cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import projection, query, statement

R = "round"

statement("conditional_counts", """
    SELECT revision, count(*) AS n, CAST(sum(CASE WHEN status = 'SUCCEEDED' THEN 1 ELSE 0 END) AS bigint) AS succeeded, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS bigint) AS failed,
      round(avg(latency), 4) AS mean_latency, min(latency) AS least, max(latency) AS most FROM runs GROUP BY revision""")
statement("group_by_keys", "SELECT revision, status, agent % 7 AS shard, count(*) AS n FROM runs GROUP BY revision, status, agent % 7")
statement("having_no_pending", """
    SELECT count(*) AS n FROM (SELECT agent FROM runs GROUP BY agent HAVING sum(CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END) = 0) q""")
statement("coalesced_sums", """
    SELECT coalesce(round(sum(CASE WHEN status = 'MISSING' THEN latency END), 2), 0e0) AS none, coalesce(round(sum(CASE WHEN status = 'FAILED' THEN latency END), 2), 0e0) AS failed, coalesce(round(sum(latency), 2), 0e0) AS whole FROM runs""")
statement("row_counts", """
    SELECT 'runs' AS name, count(*) AS n FROM runs UNION ALL SELECT 'evals', count(*) FROM evals UNION ALL SELECT 'ticks', count(*) FROM ticks UNION ALL SELECT 'decisions', count(*) FROM decisions""")
statement("hold_audit_by_horizon", """
    WITH classed AS (SELECT horizon, greatest(0e0, cost) AS cost, CASE WHEN cost > 1e-9 AND flag = 'A' THEN 'MISSED_BUY' WHEN cost > 1e-9 AND flag = 'R' THEN 'MISSED_SELL' WHEN cost > 1e-9 THEN 'MISSED_EITHER' ELSE 'JUSTIFIED' END AS category FROM evals),
    grid AS (SELECT horizon, category FROM (SELECT DISTINCT horizon FROM classed) h CROSS JOIN (SELECT DISTINCT category FROM classed) c),
    counted AS (SELECT horizon, category, count(*) AS n, avg(cost) AS mean_cost FROM classed GROUP BY horizon, category),
    sizes AS (SELECT horizon, count(*) AS total FROM classed GROUP BY horizon)
    SELECT grid.horizon, grid.category, coalesce(n, 0) AS n, round(1e2 * coalesce(n, 0) / total, 6) AS share, round(coalesce(mean_cost, 0e0), 4) AS mean_cost
    FROM grid JOIN sizes ON grid.horizon = sizes.horizon LEFT JOIN counted ON grid.horizon = counted.horizon AND grid.category = counted.category""")
statement("cost_thresholds", """
    SELECT horizon, t.threshold, CAST(sum(CASE WHEN greatest(0e0, cost) > t.threshold THEN 1 ELSE 0 END) AS bigint) AS above
    FROM evals CROSS JOIN (SELECT 0 AS threshold UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20 UNION ALL SELECT 50) t GROUP BY horizon, t.threshold""")
statement("transition_matrix_zero_filled", """
    WITH moves AS (SELECT r.status AS source, e.flag AS target, count(*) AS n FROM runs r JOIN evals e ON r.decision_id = e.decision_id GROUP BY r.status, e.flag),
    grid AS (SELECT source, target FROM (SELECT 'PENDING' AS source UNION ALL SELECT 'SUCCEEDED' UNION ALL SELECT 'FAILED' UNION ALL SELECT 'ABANDONED') a CROSS JOIN (SELECT 'A' AS target UNION ALL SELECT 'R' UNION ALL SELECT 'N' UNION ALL SELECT 'X') b)
    SELECT grid.source, grid.target, coalesce(n, 0) AS n, round(1e2 * coalesce(n, 0) / (SELECT sum(n) FROM moves), 6) AS share FROM grid LEFT JOIN moves ON grid.source = moves.source AND grid.target = moves.target""")
statement("freshness_status", """
    SELECT CASE WHEN stale IS NULL AND latency >= 2e5 THEN 'STALE_BY_BUDGET' WHEN stale IS NULL THEN 'FRESH_BY_BUDGET' WHEN stale = 1 THEN 'STALE' ELSE 'FRESH' END AS freshness, count(*) AS n
    FROM (SELECT latency, CASE WHEN decision_id % 5 = 0 THEN NULL ELSE decision_id % 2 END AS stale FROM runs) q GROUP BY 1""")
statement("evaluation_coverage", """
    SELECT flag, count(*) AS n, count(DISTINCT decision_id) AS decisions, count(DISTINCT horizon) AS horizons, round(count(*) * 1e0 / count(DISTINCT decision_id), 6) AS each_one FROM evals GROUP BY flag""")
statement("directional_distribution", """
    SELECT symbol, action, count(*) AS n, CAST(sum(CASE WHEN anchor_us IS NULL THEN 1 ELSE 0 END) AS bigint) AS skipped FROM decisions GROUP BY symbol, action""")
statement("conditional_rates", """
    WITH d AS (SELECT action, anchor_us IS NOT NULL AS anchored, ask - bid < 25e-3 AS tight, symbol < 5 AS low FROM decisions)
    SELECT p.name, CAST(sum(CASE WHEN (p.name = 'anchored' AND anchored) OR (p.name = 'tight' AND tight) OR (p.name = 'low' AND low) OR (p.name = 'all' AND anchored AND tight AND low) THEN 1 ELSE 0 END) AS bigint) AS n,
      CAST(sum(CASE WHEN action = 'HOLD' AND ((p.name = 'anchored' AND anchored) OR (p.name = 'tight' AND tight) OR (p.name = 'low' AND low) OR (p.name = 'all' AND anchored AND tight AND low)) THEN 1 ELSE 0 END) AS bigint) AS holds
    FROM d CROSS JOIN (SELECT 'anchored' AS name UNION ALL SELECT 'tight' UNION ALL SELECT 'low' UNION ALL SELECT 'all') p GROUP BY p.name""")
statement("pattern_counts", "SELECT flag, state, horizon, count(*) AS n FROM evals GROUP BY flag, state, horizon")
statement("status_lattice", """
    SELECT decision_id, CASE WHEN bool_or(flag = 'R' AND state = 'O') THEN 'INELIGIBLE' WHEN bool_or(state = 'O') AND bool_or(state = 'F') THEN 'PARTIAL' WHEN bool_or(state = 'O') THEN 'PENDING' WHEN bool_and(state = 'F') THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS status
    FROM evals GROUP BY decision_id""")
statement("distinct_sets", "SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT action) AS actions, count(DISTINCT symbol * 10 + length(action)) AS pairs FROM decisions")

@query("""
    WITH candidates AS (SELECT DISTINCT horizon AS shift FROM evals), samples AS (SELECT decision_id, min(lag) AS lag FROM evals GROUP BY decision_id)
    SELECT shift, count(*) AS n, CAST(sum(CASE WHEN lag - shift >= 0 THEN 1 ELSE 0 END) AS bigint) AS valid, sum(CASE WHEN lag - shift >= 0 THEN 1 ELSE 0 END) = count(*) AS holds_for_all FROM samples CROSS JOIN candidates GROUP BY shift""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which offsets hold for all decisions, by counts of their least lags."""
    evals = projection(spark, sf_dir, "evals")
    lags = evals.groupBy("decision_id").agg(F.min("lag").alias("lag")).groupBy("lag").agg(F.count("*").alias("k"))
    each = lags.crossJoin(evals.select(F.col("horizon").alias("shift")).distinct()).groupBy("shift")
    out = each.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("lag") >= F.col("shift"), F.col("k")).otherwise(0)).alias("valid"))
    return out.withColumn("holds_for_all", F.col("valid") == F.col("n"))


statement("series_summary", """
    SELECT symbol, round(min_by(close, day_us), 6) AS first_close, round(max_by(close, day_us), 6) AS last_close, round(max_by(close, day_us) - min_by(close, day_us), 6) AS delta,
      round(1e2 * (max_by(close, day_us) - min_by(close, day_us)) / nullif(min_by(close, day_us), 0), 6) AS pct, count(*) AS n FROM bars GROUP BY symbol""")
statement("exclusion_reason_counts", """
    SELECT coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n FROM (SELECT CASE WHEN anchor_us IS NULL THEN 'MISSING_ANCHOR' WHEN symbol = 7 THEN 'SYMBOL' WHEN ask - bid > 45e-3 THEN 'SPREAD' WHEN action = 'HOLD' AND decision_id % 2 = 0 THEN 'NON_DIRECTIONAL' END AS reason FROM decisions) q GROUP BY 1""")
statement("collected_reasons", """
    SELECT decision_id, CASE WHEN anchor_us IS NULL THEN 'MISSING_ANCHOR;' ELSE '' END || CASE WHEN symbol = 7 THEN 'SYMBOL;' ELSE '' END || CASE WHEN ask - bid > 45e-3 THEN 'SPREAD;' ELSE '' END || CASE WHEN action = 'HOLD' THEN 'NON_DIRECTIONAL;' ELSE '' END AS reasons,
      anchor_us IS NOT NULL AND symbol <> 7 AND ask - bid <= 45e-3 AND action <> 'HOLD' AS eligible FROM decisions""")
statement("hourly_clusters", """
    WITH hours AS (SELECT strategy, us - us % 3600000000 AS hour_us, sum(pnl) AS total, count(*) AS n FROM trades GROUP BY strategy, us - us % 3600000000)
    SELECT strategy, count(*) AS clusters, round(sum(total) / sum(n), 6) AS mean, round(stddev_samp(total / n), 4) AS spread FROM hours GROUP BY strategy""")
statement("weakness_grouping_sets", """
    SELECT strategy, session, count(*) AS n, round(avg(pnl), 4) AS expectancy, round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM trades GROUP BY GROUPING SETS ((), (strategy), (session)) HAVING count(*) >= 20 AND avg(pnl) < 5e2""")
statement("cube_rollup_extra", "SELECT flag, state, count(*) AS n, CAST(grouping(flag) AS bigint) AS g FROM evals GROUP BY ROLLUP (flag, state)")
statement("replay_merge", """
    WITH w AS (SELECT strategy, symbol % 4 AS part, count(*) AS n, avg(pnl) AS mean, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0e0 END), 0) AS factor FROM trades GROUP BY strategy, symbol % 4)
    SELECT strategy, CAST(sum(n) AS bigint) AS n, round(sum(mean * n) / sum(n), 6) AS weighted_mean, round(min(factor), 6) AS least_factor FROM w GROUP BY strategy""")
statement("cost_calibration", "SELECT round(@p(slippage, 0.95), 6) AS p95_slippage, round(median(volume), 6) AS median_latency, round(@p(volume, 0.99), 6) AS p99_latency, count(*) AS n FROM trades WHERE us <= (SELECT CAST(floor(avg(us)) AS bigint) FROM trades)")
