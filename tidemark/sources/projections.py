"""The engine's tables, projected from the generic test tables (a deployment reads its own).

``@us(x)`` stands for microseconds since the epoch, ``@day(x)`` for the date, ``@p(x, q)`` and
``@d(x, q)`` for the linear and the nearest-rank quantile, in either engine.
"""

from __future__ import annotations

import re

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

PROJECTIONS = {
    # quotes by symbol: mid from the value, spread from the id
    "ticks": """SELECT event_id, user_id % 10 AS symbol, @us(ts) AS us, 1e2 + value - 5e-3 * (1 + event_id % 5) AS bid, 1e2 + value + 5e-3 * (1 + event_id % 5) AS ask,
        1e2 + value AS mid, 1e-2 * (1 + event_id % 5) AS spread, 1e-2 AS point, event_type FROM events""",
    # the same in arrival order with disturbed, repeated and invalid quotes
    "arrivals": """SELECT event_id AS arrival, symbol, us - ((event_id * 37) % 11) * 60000000 AS us, CASE WHEN event_id % 97 = 0 THEN -bid WHEN event_id % 89 = 0 THEN ask + 1e0 ELSE bid END AS bid, ask FROM ticks
        UNION ALL SELECT event_id + 100000000, symbol, us - ((event_id * 37) % 11) * 60000000, CASE WHEN event_id % 97 = 0 THEN -bid WHEN event_id % 89 = 0 THEN ask + 1e0 ELSE bid END, ask FROM ticks WHERE event_id % 53 = 0""",
    "decisions": """SELECT event_id AS decision_id, symbol, us, bid, ask, point, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS action,
        CASE WHEN event_id % 29 = 0 THEN NULL ELSE us END AS anchor_us FROM ticks WHERE event_type = 'purchase'""",
    "runs": """SELECT o_orderkey AS decision_id, o_custkey AS agent, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, o_totalprice AS latency,
        o_orderpriority AS revision, @us(o_orderdate) AS us FROM orders""",
    "evals": """SELECT l_orderkey AS decision_id, l_linenumber AS horizon, l_extendedprice * (l_discount - 5e-2) AS cost, l_quantity AS lag, l_returnflag AS flag, l_linestatus AS state, l_partkey AS part, @us(l_shipdate) AS us FROM lineitem""",
    "trades": """SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_returnflag AS strategy, l_linestatus AS session, l_suppkey AS symbol, l_extendedprice * (l_discount - 5e-2) AS pnl, l_quantity AS volume, l_tax AS slippage, @us(l_shipdate) AS us FROM lineitem""",
    "bars": """SELECT symbol, us - us % 86400000000 AS day_us, min_by(mid, us) AS open, max(mid) AS high, min(mid) AS low, max_by(mid, us) AS close, sum(ask) AS volume FROM ticks GROUP BY symbol, us - us % 86400000000""",
    # records of past decisions, some damaged, withdrawn or of another schema
    "experiences": """SELECT o_orderkey AS experience_id, CONCAT('S', CAST(o_custkey % 3 AS varchar(8))) AS symbol, CASE WHEN o_orderkey % 7 = 0 THEN 'SWING' ELSE 'INTRADAY' END AS profile, CASE WHEN o_orderkey % 9 = 0 THEN 'H1' ELSE 'M15' END AS timeframe,
        CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'X' ELSE 'A' END AS tier, CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS tombstoned, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS aliases,
        CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS current_aliases, o_orderkey % 23 <> 0 AS accepted, o_orderkey % 29 = 0 AS conflict, o_orderkey % 31 <> 0 AS provenance_valid, CASE o_orderkey % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS action,
        @us(o_orderdate) AS snapshot_us, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE @us(o_orderdate) + 60000000 END AS completed_us, CASE WHEN o_orderkey % 41 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, CASE WHEN o_orderkey % 43 = 0 THEN 'x1' ELSE 'x2' END AS extractor_version, o_custkey % 2 AS cohort FROM orders""",
    # evaluations of them as they became known
    "snapshots": """SELECT l_orderkey AS experience_id, CASE WHEN l_linenumber % 3 = 0 THEN 'DECISION_REFERENCE' ELSE 'ANALYSIS_SNAPSHOT' END AS basis, 3600 * (1 + l_linenumber % 2) AS horizon_s, CASE l_partkey % 7 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'DATA_UNAVAILABLE' ELSE 'COMPLETE' END AS status,
        CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE @us(l_shipdate) END AS available_us, @us(l_shipdate) - 60000000 * (l_suppkey % 3 - 1) AS observed_us, CASE WHEN l_suppkey % 13 = 0 THEN 0 ELSE 1 END AS context_ok, CASE WHEN l_suppkey % 5 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS reference_status,
        CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS net, CASE l_partkey % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' ELSE 'NONE' END AS action, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_tax END AS hold_cost,
        CONCAT(CAST(l_partkey AS varchar(20)), '-', CAST(l_suppkey AS varchar(20)), '-', CAST(l_linenumber AS varchar(20))) AS fingerprint FROM lineitem""",
    # joined observations of a dataset
    "observations": """SELECT o_orderkey AS decision_id, o_custkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'B' ELSE 'A' END AS tier, CASE WHEN o_orderkey % 13 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS context, o_orderkey % 17 <> 0 AS audit, CASE WHEN o_orderkey % 19 = 0 THEN 'DEGRADED' ELSE 'COMPLETE' END AS integrity,
        o_orderkey % 23 <> 0 AS artifacts, @us(o_orderdate) AS analysis_us, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE @us(o_orderdate) + 60000000 * (o_orderkey % 31 - 1) END AS completed_us, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE @us(o_orderdate) + 3600000000 * (o_orderkey % 7) END AS reference_us,
        CASE WHEN o_orderkey % 37 = 0 THEN 'FAILED' ELSE 'NORMALIZED' END AS normalization, CASE o_orderkey % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' ELSE CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'HOLD' END END AS action, CASE WHEN o_orderkey % 43 = 0 THEN 'STALE' ELSE 'VALID' END AS audit_status,
        CASE WHEN o_orderkey % 47 = 0 THEN 'unsupported.v9' ELSE 'v2' END AS schema_version, o_orderkey % 53 <> 0 AS provenance_valid, o_orderkey % 59 = 0 AS duplicate, o_orderkey % 61 <> 0 AS source_available, o_orderkey % 6 <> 0 AS evaluated, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'ANALYSIS_SNAPSHOT' END AS eval_basis,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN 60 ELSE 3600 END AS eval_horizon_s, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'PENDING' ELSE 'COMPLETE' END AS eval_status, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 71 <> 0 END AS eval_context_ok,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 73 <> 0 END AS eval_provenance_valid, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE @us(o_orderdate) + 86400000000 END AS known_us, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE @us(o_orderdate) + 1000000 END AS entry_us,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE @us(o_orderdate) + 3600000000 END AS target_us, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE @us(o_orderdate) + 3600000000 * (o_orderkey % 10 - 1) END AS observed_us, o_orderkey % 8 AS refs FROM orders""",
    # the three sources of a dataset: decisions (some twice), records and audits of them, evaluations and snapshots by the time they were known
    "ds_decisions": """SELECT decision_id, run_id, CONCAT('f', CAST(run_id % 3 AS varchar(8))) AS fp, analysis_us, completed_us, reference_us, normalization, action, context, schema_version, artifacts, copy FROM (SELECT *, 0 AS copy FROM observations UNION ALL SELECT *, 1 AS copy FROM observations WHERE decision_id % 97 = 0) o""",
    "ds_records": """SELECT decision_id, run_id + CASE WHEN decision_id % 101 = 0 THEN 1 ELSE 0 END AS run_id, CONCAT('f', CAST(run_id % 3 AS varchar(8))) AS fp, tier, provenance_valid, copy FROM (SELECT *, 0 AS copy FROM observations UNION ALL SELECT *, 1 AS copy FROM observations WHERE decision_id % 103 = 0) o WHERE decision_id % 107 <> 0""",
    "ds_audits": """SELECT decision_id, run_id, audit_status, integrity, refs, copy FROM (SELECT *, 0 AS copy FROM observations UNION ALL SELECT *, 1 AS copy FROM observations WHERE decision_id % 109 = 0) o WHERE audit""",
    "ds_evals": """SELECT CONCAT(CAST(l_orderkey AS varchar(20)), '-', CAST(l_linenumber AS varchar(20)), '-', CAST(l_partkey AS varchar(20)), '-', CAST(l_suppkey AS varchar(20))) AS eval_id, l_orderkey AS decision_id, CAST(NULL AS bigint) AS run_id, CASE WHEN l_partkey % 5 = 0 THEN CONCAT('f', CAST(l_suppkey % 3 AS varchar(8))) END AS fp, CASE WHEN l_linenumber % 3 = 0 THEN 'DECISION_REFERENCE' ELSE 'ANALYSIS_SNAPSHOT' END AS basis,
        CAST(3600 * (1 + l_linenumber % 2) AS bigint) AS horizon_s, CASE l_partkey % 7 WHEN 0 THEN 'PENDING' ELSE 'COMPLETE' END AS status, CONCAT('e', CAST(l_partkey % 6 AS varchar(8))) AS fingerprint, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE @us(l_shipdate) END AS known_us FROM lineitem""",
    "ds_snapshots": """SELECT l_orderkey AS decision_id, CASE WHEN l_suppkey % 3 = 0 THEN 'DECISION_REFERENCE' ELSE 'ANALYSIS_SNAPSHOT' END AS basis, CAST(3600 * (1 + l_suppkey % 2) AS bigint) AS horizon_s, CASE l_suppkey % 5 WHEN 0 THEN 'PENDING' ELSE 'COMPLETE' END AS status,
        CONCAT('e', CAST((l_suppkey + l_linenumber) % 6 AS varchar(8))) AS fingerprint, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE @us(l_shipdate) - 864000000000 * (l_suppkey % 3 - 1) END AS observed_us FROM lineitem""",
    # decisions and the runs that made them
    "verdicts": """SELECT o_orderkey AS decision_id, o_custkey AS run_id, CONCAT('fx', CAST(o_custkey % 5 AS varchar(8))) AS symbol, @us(o_orderdate) AS us, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS executed, CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'NORMALIZED' END AS normalization, 'COMPLETE' AS context,
        CASE o_orderkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS action, CASE WHEN o_orderkey % 4 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS reference_status, o_totalprice / 1e3 AS latency_s FROM orders""",
    "watch_runs": """SELECT o_orderkey AS decision_id, o_custkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'SUCCEEDED_SLOW' WHEN 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS context, 'NORMALIZED' AS normalization, 'AVAILABLE' AS reference_status,
        CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS stale, 250 AS budget_s FROM orders""",
    # entries as a risk gate sees them
    "entries": """SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_suppkey AS symbol, @us(l_shipdate) - @us(l_shipdate) % 86400000000 AS day_us, @us(l_shipdate) AS us, l_extendedprice * (l_discount - 5e-2) AS pnl, CASE l_linenumber % 4 WHEN 0 THEN 'EXIT' WHEN 1 THEN 'ENTER_LONG' ELSE 'ENTER_SHORT' END AS action,
        l_partkey % 31 = 0 AS expired, CASE l_partkey % 3 WHEN 0 THEN 'asia' WHEN 1 THEN 'London' ELSE 'NEW_YORK' END AS session, l_partkey % 7 * 1e0 AS age_s, l_quantity / 2 AS spread_points, l_tax * 1e2 AS slippage_points, l_discount * 1e3 AS drawdown, l_quantity / 10 AS exposure FROM lineitem""",
    # telemetry of agents as nested JSON
    "metrics": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 17 = 0 THEN '{"agents": 3}' WHEN o_orderkey % 19 = 0 THEN 'damaged' ELSE CONCAT('{"agents": {"trader": {"model": "m', CAST(o_custkey % 3 AS varchar(8)), '", "calls": ', CAST(o_custkey % 7 AS varchar(8)), ', "tokens_in": ', CAST(o_custkey AS varchar(20)),
        ', "tokens_out": 5, "elapsed_seconds": ', CAST(o_custkey % 100 AS varchar(8)), '.5}, "judge": {"model": " m9 ", "calls": -4, "tokens_in": 1, "tokens_out": 2}}}') END AS metrics_json FROM orders""",
}

_SPARK = [(r"@sha\(", "sha2_hex("), (r"@words\((\w+)\)", r"filter(split(lower(\1), '[\\\\s.,!?|]+'), w -> w <> '')"), (r"@us\(([^()]*)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))"), (r"@p\(([^,()]*(?:\([^()]*\))?[^,()]*), ([\d.]+)\)", r"percentile(\1, \2D)"), (r"@d\(([^,]*), ([\d.]+)\)", r"percentile_disc(\2D) WITHIN GROUP (ORDER BY \1)")]
_DUCK = [(r"@sha\(", "sha256("), (r"@words\((\w+)\)", r"list_filter(regexp_split_to_array(lower(\1), '[\\s.,!?|]+'), lambda w: w <> '')"), (r"@us\(([^()]*)\)", r"epoch_us(\1)"), (r"@p\(([^,()]*(?:\([^()]*\))?[^,()]*), ([\d.]+)\)", r"quantile_cont(\1, \2::double)"), (r"@d\(([^,]*), ([\d.]+)\)", r"quantile_disc(\1, \2)")]


def _replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        text = re.sub(pattern, by, text)
    return text


def spark_form(text: str) -> str:
    return re.sub(r"sha2_hex\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(CAST(\1 AS binary), 256)", _replaced(text, _SPARK))


def duck_form(text: str) -> str:
    return _replaced(text, _DUCK)
