"""Ordered analytics over ticks, bars and trades: quality flags, segments, indicators, drawdowns."""

from __future__ import annotations

from tidemark.plans.registry import statement

statement("valid_quote_flags", """
    SELECT arrival, bid > 0 AND ask > 0 AND ask >= bid AS dataset_rule, bid > 0 AND ask >= bid AS quality_rule, ask >= bid AS evaluator_rule FROM arrivals""")
statement("dedupe_first_arrival", """
    SELECT symbol, us, bid, ask, arrival FROM (SELECT *, row_number() OVER (PARTITION BY symbol, us, bid, ask ORDER BY arrival) AS rn FROM arrivals) q WHERE rn = 1""")
statement("collision_drop", "SELECT symbol, us, arrival FROM (SELECT symbol, us, arrival, row_number() OVER (PARTITION BY symbol, us ORDER BY arrival) AS rn FROM arrivals WHERE bid > 0 AND ask >= bid) q WHERE rn = 1")
statement("daily_bars", "SELECT symbol, day_us, open, high, low, close, round(volume, 4) AS volume FROM bars")
statement("tumbling_bars", """
    SELECT symbol, us - us % 900000000 AS start_us, min_by(mid, us) AS open, max(mid) AS high, min(mid) AS low, max_by(mid, us) AS close, count(*) AS n FROM ticks GROUP BY symbol, us - us % 900000000""")
statement("true_range_atr", """
    WITH p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day_us) AS before_close FROM bars),
    t AS (SELECT symbol, day_us, CASE WHEN before_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - before_close), abs(low - before_close)) END AS tr FROM p)
    SELECT symbol, day_us, round(tr, 6) AS tr, round(avg(tr) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS atr FROM t""")
statement("sma_bollinger", """
    SELECT symbol, day_us, round(avg(close) OVER w, 6) AS mid_band, round(avg(close) OVER w + 2 * stddev_samp(close) OVER w, 4) AS upper_band, round(avg(close) OVER w - 2 * stddev_samp(close) OVER w, 4) AS lower_band,
      round(avg(close) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS sma_50 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
statement("vwma_mfi", """
    WITH p AS (SELECT symbol, day_us, close, volume, (high + low + close) / 3 AS typical FROM bars), q AS (SELECT *, lag(typical) OVER (PARTITION BY symbol ORDER BY day_us) AS was FROM p),
    f AS (SELECT symbol, day_us, sum(close * volume) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / sum(volume) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS vwma,
      sum(CASE WHEN typical > was THEN typical * volume ELSE 0e0 END) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS up, sum(CASE WHEN typical < was THEN typical * volume ELSE 0e0 END) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS down FROM q)
    SELECT symbol, day_us, round(vwma, 6) AS vwma, CASE WHEN up + down > 0 THEN round(1e2 * up / (up + down), 6) END AS mfi FROM f""")
statement("forward_return_alpha", """
    WITH f AS (SELECT symbol, day_us, lead(close, 5) OVER (PARTITION BY symbol ORDER BY day_us) / close - 1 AS r FROM bars)
    SELECT a.symbol, a.day_us, round(a.r, 6) AS ret, round(b.r, 6) AS benchmark_ret, round(a.r - b.r, 6) AS alpha FROM f a JOIN f b ON a.day_us = b.day_us AND b.symbol = 0 WHERE a.symbol <> 0 AND a.r IS NOT NULL AND b.r IS NOT NULL""")
statement("recent_tail", "SELECT symbol, day_us, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day_us DESC) AS rn FROM bars) q WHERE rn <= 10")
statement("bars_by_position", "SELECT symbol, us, mid FROM (SELECT symbol, us, mid, row_number() OVER (PARTITION BY symbol ORDER BY us DESC) AS rn FROM ticks) q WHERE rn BETWEEN 4 AND 13")
statement("asof_cutoff", "SELECT symbol, day_us, close FROM bars WHERE day_us <= 1705276800000000")
statement("half_open_window", "SELECT event_id, symbol FROM ticks WHERE us >= 1704931200000000 AND us < 1705276800000000 + 86400000000")
statement("staleness_guard", """
    SELECT symbol, max(day_us) AS last_us, CASE WHEN 1707523200000000 - max(day_us) > 864000000000 THEN 'STALE' ELSE 'CURRENT' END AS status, max_by(close, day_us) IS NOT NULL AS has_close FROM bars GROUP BY symbol""")
statement("coerced_numbers", """
    SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN '.' ELSE CAST(event_id AS varchar(20)) END AS double) AS number FROM ticks""")
statement("candle_features", """
    SELECT symbol, count(*) AS n, max(high) AS high, min(low) AS low, round(max_by(close, day_us) / min_by(open, day_us) - 1, 6) AS return_over_bars, round((max(high) - min(low)) / min(low), 6) AS range_pct,
      round((max_by(close, day_us) - min(low)) / nullif(max(high) - min(low), 0), 6) AS close_position, CASE WHEN max_by(close, day_us) > min_by(open, day_us) THEN 1 WHEN max_by(close, day_us) < min_by(open, day_us) THEN -1 ELSE 0 END AS direction FROM bars GROUP BY symbol""")
statement("trading_sessions", """
    SELECT CASE WHEN h >= 7 AND h < 12 THEN 'LONDON' WHEN h >= 12 AND h < 16 THEN 'OVERLAP' WHEN h >= 16 AND h < 21 THEN 'NEW_YORK' ELSE 'ASIA' END AS session, CASE WHEN h < 7 THEN 'ASIA' WHEN h < 13 THEN 'LONDON' WHEN h < 21 THEN 'NEW_YORK' ELSE 'OFF_HOURS' END AS dataset_session, count(*) AS n
    FROM (SELECT CAST(floor(us % 86400000000 / 36e8) AS int) AS h FROM ticks) q GROUP BY 1, 2""")
statement("cyclic_hours", "SELECT event_id, round(sin(2 * pi() * (us % 86400000000 / 36e8) / 24), 6) AS hour_sin, round(cos(2 * pi() * (us % 86400000000 / 36e8) / 24), 6) AS hour_cos FROM ticks")
statement("running_excursion", """
    SELECT decision_id, us, round(max(cost) OVER (PARTITION BY decision_id ORDER BY horizon, part, us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS mfe, round(min(cost) OVER (PARTITION BY decision_id ORDER BY horizon, part, us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS mae FROM evals""")
statement("failure_run_lengths", """
    WITH f AS (SELECT agent, decision_id, status, row_number() OVER (PARTITION BY agent ORDER BY us, decision_id) AS rn, row_number() OVER (PARTITION BY agent, status ORDER BY us, decision_id) AS rs FROM runs),
    r AS (SELECT agent, status, rn - rs AS island, count(*) AS n FROM f GROUP BY agent, status, rn - rs)
    SELECT agent, max(n) AS longest FROM r WHERE status = 'FAILED' GROUP BY agent""")
statement("fill_prices", """
    SELECT decision_id, action, round(CASE action WHEN 'BUY' THEN ask + 2 * point WHEN 'SELL' THEN bid - 2 * point END, 6) AS entry_fill, round(CASE action WHEN 'BUY' THEN bid - 2 * point WHEN 'SELL' THEN ask + 2 * point END, 6) AS exit_fill FROM decisions""")
statement("signal_arbitration", """
    SELECT symbol, us, strategy, strength FROM (SELECT *, row_number() OVER (PARTITION BY symbol, us ORDER BY priority, strength DESC, strategy) AS rn FROM (
      SELECT symbol, us, 'momentum' AS strategy, 1 AS priority, mid - 1e2 AS strength FROM ticks WHERE mid - 1e2 > spread + 5e1 UNION ALL SELECT symbol, us, 'range', 2, 2e2 - mid FROM ticks WHERE 2e2 - mid > spread + 1e1) s) q WHERE rn = 1""")
