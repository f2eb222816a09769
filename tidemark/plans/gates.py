"""Gates over records, decisions, entries and pages. Each oracle states its gate as nested cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import gates, scans
from tidemark.plans.registry import projection, query
from tidemark.session import table

AS_OF = 852_076_800_000_000

_PASS = """CASE WHEN tombstoned IS NULL OR aliases = 0 THEN 'tombstone' WHEN symbol <> 'S1' THEN 'symbol' WHEN profile <> 'INTRADAY' THEN 'profile' WHEN timeframe <> 'M15' THEN 'timeframe' WHEN coalesce(tier, '?') NOT IN ('A', 'B') THEN 'trust_tier'
    WHEN NOT accepted OR conflict OR NOT provenance_valid THEN 'provenance' WHEN action <> 'HOLD' THEN 'action'"""
_OTHER = "CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN g.cohort <> f.cohort THEN 'cohort' WHEN g.schema_version <> f.schema_version THEN 'feature_schema' WHEN g.extractor_version <> f.extractor_version THEN 'feature_extractor' END"


def _search(late: str) -> str:
    return f"WITH g AS (SELECT *, {_PASS} {late} END AS reason FROM experiences), f AS (SELECT cohort, schema_version, extractor_version FROM g WHERE reason IS NULL ORDER BY experience_id LIMIT 1)"


@query(f"{_search(f'WHEN completed_us IS NULL OR snapshot_us >= {AS_OF} OR completed_us >= {AS_OF} THEN ' + chr(39) + 'as_of' + chr(39))} SELECT g.experience_id, {_OTHER} AS reason FROM g, f")
def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a record may not be compared as of an instant: the first rule that fails."""
    return gates.search_gate(projection(spark, sf_dir, "experiences"), "S1", "INTRADAY", "M15", action="HOLD", as_of_us=AS_OF).select("experience_id", "reason")


@query(f"{_search('WHEN tombstoned = 1 OR current_aliases = 0 THEN ' + chr(39) + 'tombstone' + chr(39))} SELECT coalesce({_OTHER}, 'ACCEPTED') AS reason, count(*) AS n FROM g, f GROUP BY 1")
def similarity_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each rule keeps out of a search of what is current."""
    rows = gates.search_gate(projection(spark, sf_dir, "experiences"), "S1", "INTRADAY", "M15", action="HOLD")
    return rows.groupBy(F.coalesce("reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
    WITH r AS (SELECT o_orderkey AS experience_id FROM orders UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 97 = 0),
    x AS (SELECT * FROM snapshots WHERE basis = 'ANALYSIS_SNAPSHOT' AND horizon_s = 3600), a AS (SELECT experience_id, count(*) AS n FROM snapshots GROUP BY 1), e AS (SELECT experience_id, count(*) AS n FROM x GROUP BY 1),
    k AS (SELECT * FROM x WHERE available_us <= {AS_OF} AND (status <> 'COMPLETE' OR observed_us <= {AS_OF}) QUALIFY row_number() OVER (PARTITION BY experience_id ORDER BY available_us DESC, fingerprint DESC) = 1),
    j AS (SELECT r.experience_id, p.experience_id AS found, p.tier, a.n AS any_n, e.n AS exact_n, k.* EXCLUDE (experience_id), k.experience_id AS hit FROM r LEFT JOIN experiences p ON p.experience_id = r.experience_id LEFT JOIN a ON a.experience_id = r.experience_id LEFT JOIN e ON e.experience_id = r.experience_id LEFT JOIN k ON k.experience_id = r.experience_id),
    w AS (SELECT *, CASE WHEN found IS NULL THEN 'EXPERIENCE_NOT_FOUND' WHEN any_n IS NULL THEN 'EVALUATION_NOT_AVAILABLE' WHEN exact_n IS NULL THEN 'BASIS_OR_HORIZON_MISMATCH' WHEN hit IS NULL THEN 'EVALUATION_NOT_YET_AVAILABLE' WHEN tier IS NULL OR tier = 'X' THEN 'TRUST_TIER_INVALID'
      WHEN tier <> 'A' THEN 'TRUST_TIER_NOT_ALLOWED' WHEN status <> 'COMPLETE' THEN status WHEN context_ok <> 1 THEN 'SOURCE_CONTEXT_INELIGIBLE' WHEN net IS NULL OR (action = 'HOLD' AND hold_cost IS NULL) THEN 'REQUIRED_FIELD_MISSING_OR_NONFINITE' WHEN action = 'NONE' THEN 'SELECTED_ACTION_INVALID' END AS reason FROM j)
    SELECT experience_id, reason, CASE WHEN reason IS NULL THEN fingerprint END AS fingerprint FROM w""")
def outcome_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an experience's outcome can't be counted as of an instant."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experience_id"))
    asked = ids.union(ids.where("experience_id % 97 = 0").select(F.col("experience_id") + 1_000_000_000))
    return gates.outcome_exclusions(asked, projection(spark, sf_dir, "experiences"), projection(spark, sf_dir, "snapshots"), "ANALYSIS_SNAPSHOT", 3600, AS_OF)


#: A record's references: those available, used (even) and rejected (odd), some listed twice or lost.
_LISTS = {"available": "sequence(0L, refs)", "used": "filter(sequence(0L, refs), x -> x % 2 = 0 and not (decision_id % 79 = 0 and x = 0))", "rejected": "filter(sequence(0L, refs), x -> x % 2 = 1 or (decision_id % 83 = 0 and x = 0))"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection(spark, sf_dir, "observations").withColumns({k: F.expr(v) for k, v in _LISTS.items()})


@query("""
    SELECT decision_id, CASE WHEN context = 'COMPLETE' THEN CASE WHEN normalization = 'NORMALIZED' THEN CASE WHEN action IN ('BUY', 'SELL', 'HOLD') THEN CASE WHEN completed_us IS NULL THEN 'ANALYSIS_TIMESTAMP_INVALID' ELSE 'ELIGIBLE_SOURCE_CONTEXT' END ELSE 'ACTION_UNAVAILABLE' END ELSE 'NORMALIZATION_FAILED' END
      ELSE 'DECISION_CONTEXT_INCOMPLETE' END AS eligibility FROM observations""")
def source_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four rules that keeps a decision from being evaluated."""
    c = F.col
    return projection(spark, sf_dir, "observations").select("decision_id", gates.source_eligibility(c("context"), c("normalization"), c("action"), c("completed_us")).alias("eligibility"))


_LATE = " OR ".join(f"{c} > {AS_OF}" for c in ("analysis_us", "completed_us", "reference_us"))
_LATE_EVAL = " OR ".join(f"{c} > {AS_OF}" for c in ("known_us", "entry_us", "observed_us", "target_us"))
_REASONS = f"""d AS (SELECT *, coalesce(audit, false) AND integrity = 'COMPLETE' AS whole, (decision_id % 79 = 0) = (decision_id % 83 = 0) AS parted FROM observations),
    l AS (SELECT decision_id, run_id, analysis_us, list_filter([CASE WHEN tier <> 'A' THEN 'UNTRUSTED_TIER' END, CASE WHEN context <> 'COMPLETE' OR NOT whole OR NOT artifacts THEN 'DECISION_CONTEXT_INCOMPLETE' END,
      CASE WHEN completed_us IS NULL OR completed_us < analysis_us OR reference_us < analysis_us OR reference_us < completed_us OR {_LATE} OR (evaluated AND ({_LATE_EVAL} OR target_us < analysis_us OR entry_us > target_us OR observed_us < entry_us)) THEN 'TEMPORAL_INVALID' END,
      CASE WHEN evaluated AND (eval_horizon_s <> 3600 OR eval_status <> 'COMPLETE' OR NOT eval_context_ok) THEN 'OUTCOME_INELIGIBLE' END, CASE WHEN NOT evaluated THEN 'OUTCOME_UNAVAILABLE' END, CASE WHEN normalization <> 'NORMALIZED' OR action IS NULL THEN 'NORMALIZATION_FAILED' END,
      CASE WHEN NOT audit OR audit_status <> 'VALID' OR NOT parted THEN 'CITATION_INVALID' END, CASE WHEN NOT whole THEN 'EVIDENCE_INCOMPLETE' END, CASE WHEN schema_version LIKE 'unsupported%' THEN 'SCHEMA_UNSUPPORTED' END, CASE WHEN NOT provenance_valid OR (evaluated AND NOT eval_provenance_valid) THEN 'PROVENANCE_INCOMPLETE' END,
      CASE WHEN duplicate THEN 'DUPLICATE' END, CASE WHEN NOT source_available THEN 'SOURCE_INTEGRITY_FAILED' END], lambda x: x IS NOT NULL) AS reasons FROM d)"""


@query(f"WITH {_REASONS} SELECT decision_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM l")
def dataset_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons that keep an observation out of a dataset as of an instant."""
    rows = gates.dataset_reasons(observations(spark, sf_dir), "ANALYSIS_SNAPSHOT", 3600, AS_OF)
    return rows.select("decision_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))


@query("""
    WITH s AS (SELECT o_orderkey AS k, o_orderkey % 71 = 0 AS ex, o_orderkey % 37 = 0 AS norm, o_orderkey % 13 = 0 AS ctx, o_orderkey % 41 = 0 AS act, o_orderkey % 29 = 0 AS done, o_orderkey % 31 = 0 AS early, o_orderkey % 43 = 0 AS refbad, o_orderkey % 47 = 0 AS reft, o_orderkey % 24 AS f, o_orderkey % 53 = 0 AS prov, o_orderkey % 59 = 0 AS quote FROM orders),
    r AS (SELECT k, f, list_filter([CASE WHEN ex THEN 'EXECUTED' END, CASE WHEN norm THEN 'NORMALIZATION_FAILED' END, CASE WHEN ctx THEN 'CONTEXT_INCOMPLETE' END, CASE WHEN act THEN 'ACTION_INVALID' END, CASE WHEN done THEN 'COMPLETION_UNAVAILABLE' END, CASE WHEN (early AND NOT done) OR (reft AND NOT refbad) THEN 'TEMPORAL_INVALID' END,
      CASE WHEN refbad THEN 'REFERENCE_STATUS_INVALID' END, CASE WHEN f < 8 THEN 'MARKET_FEATURES_INSUFFICIENT' END, CASE WHEN prov THEN 'PROVENANCE_INVALID' END, CASE WHEN quote THEN 'QUOTE_INVALID' END], lambda x: x IS NOT NULL) AS l FROM s),
    t AS (SELECT k, f, l, CASE WHEN len(l) > 0 AND l <> ['COMPLETION_UNAVAILABLE'] THEN 'C' WHEN len(l) > 0 OR f < 23 THEN 'B' ELSE 'A' END AS tier FROM r)
    SELECT k AS experience_id, tier, array_to_string(CASE WHEN tier = 'B' AND f < 23 THEN list_append(l, 'FEATURES_PARTIAL') ELSE l END, ',') AS reasons FROM t""")
def trust_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust tier of records and the reasons that lower it."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("experience_id"), F.when(k % 71 == 0, 1).otherwise(0).alias("executed"), F.when(k % 37 == 0, "FAILED").otherwise("NORMALIZED").alias("normalization"), F.when(k % 13 == 0, None).otherwise("COMPLETE").alias("context"),
        F.when(k % 41 == 0, "WAIT").otherwise("HOLD").alias("action"), F.lit(100).alias("snapshot_us"), F.when(k % 29 == 0, None).when(k % 31 == 0, 99).otherwise(101).alias("completed_us"),
        F.when(k % 43 == 0, None).when(k % 47 == 0, "INVALID_TEMPORAL").otherwise("AVAILABLE").alias("reference_status"), (k % 24).alias("features"), F.lit(23).alias("all_features"), (k % 53 != 0).alias("provenance_valid"), (k % 59 != 0).alias("quote_valid"),
    )
    return gates.trust_tier(rows).select("experience_id", "tier", F.array_join("reasons", ",").alias("reasons"))


@query("""
    SELECT symbol, decision_id, action FROM verdicts v WHERE executed = 0 AND normalization = 'NORMALIZED' AND (action = 'HOLD' OR (reference_status = 'AVAILABLE' AND EXISTS (SELECT 1 FROM watch_runs w WHERE w.decision_id = v.decision_id AND w.run_id = v.run_id AND w.status LIKE 'SUCCEEDED%' AND w.context = 'COMPLETE' AND w.stale = 0 AND v.latency_s <= w.budget_s)))
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY us DESC, decision_id DESC) = 1""")
def latest_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest decision of each symbol that may be acted on."""
    return gates.latest_eligible(projection(spark, sf_dir, "verdicts"), projection(spark, sf_dir, "watch_runs")).select("symbol", "decision_id", "action")


@query("""
    WITH m AS (SELECT p_partkey, p_retailprice, p_size, p_partkey % 5 = 0 AS closed, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS ends FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)
    SELECT p_partkey AS market_id, CAST(row_number() OVER (ORDER BY CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_retailprice END DESC, p_partkey) AS int) AS rank FROM m WHERE NOT closed AND (ends IS NULL OR ends >= 20) QUALIFY rank <= 10""")
def prediction_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten open markets of the largest volume, none counting as zero."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("market_id"), (k % 5 == 0).alias("closed"), F.when(k % 7 == 0, None).otherwise(F.col("p_size")).cast("bigint").alias("end_us"), F.when(k % 11 == 0, "[]").otherwise('["0.4", "0.6"]').alias("prices"),
        F.when(k % 13 == 0, "damaged").otherwise('["Yes", "No"]').alias("outcomes"), F.when(F.col("p_size") % 6 == 0, None).otherwise(F.col("p_retailprice")).alias("volume"),
    )
    top = gates.open_markets(rows, 20).select("market_id", F.coalesce("volume", F.lit(0.0)).alias("volume")).orderBy(F.desc("volume"), "market_id").limit(10)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("volume")).alias("v"), "market_id"))).alias("m"))  # ten rows
    return ranked.select(F.posexplode("m").alias("rank", "m")).select("m.market_id", (F.col("rank") + 1).alias("rank"))


@query("""
    WITH o AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(CASE WHEN pnl < 0 THEN -pnl END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS daily_loss FROM entries WINDOW w AS (PARTITION BY symbol, day_us ORDER BY us, trade_id, pnl)),
    l AS (SELECT *, rn - 1 - coalesce(max(CASE WHEN pnl >= 0 THEN rn END) OVER (PARTITION BY symbol, day_us ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM o)
    SELECT trade_id, streak AS losses_in_row, round(daily_loss, 4) AS daily_loss, CASE WHEN expired THEN 'PLAN_EXPIRED' WHEN action = 'EXIT' THEN 'NON_ENTRY' WHEN lower(session) = 'asia' THEN 'SESSION_LIMIT' WHEN age_s > 5 THEN 'STALE_TICK' WHEN spread_points > 20 THEN 'SPREAD_LIMIT' WHEN slippage_points > 7 THEN 'SLIPPAGE_LIMIT'
      WHEN daily_loss >= 1000 THEN 'DAILY_LOSS_LIMIT' WHEN drawdown >= 90 THEN 'DRAWDOWN_LIMIT' WHEN streak >= 2 THEN 'CONSECUTIVE_LOSS_LIMIT' WHEN exposure >= 3 THEN 'EXPOSURE_LIMIT' ELSE 'ACCEPTED' END AS code FROM l""")
def risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that an entry breaks; losses count by symbol and day."""
    rows = gates.losses_in_row(projection(spark, sf_dir, "entries"), ["symbol", "day_us"], ["us", "trade_id", "pnl"]).withColumn("sessions", F.array(F.lit("London"), F.lit("new_york")))
    out = gates.risk_verdict(rows, 5, 20, 7, 1000, 90, 2, 3)
    return out.select("trade_id", F.col("losses_in_row").cast("bigint").alias("losses_in_row"), F.round("daily_loss", 4).alias("daily_loss"), "code")


@query("""
    WITH p AS (SELECT page_id % 40 AS document, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s', '', 'g')) * CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS chars, page_id % 5 <> 0 AS image FROM pages),
    d AS (SELECT document, count(*) AS pages, count(*) FILTER (WHERE chars >= 64) AS with_text, count(*) FILTER (WHERE image) AS with_image, sum(chars) AS chars FROM p GROUP BY 1)
    SELECT document, pages, with_text, with_image, CASE WHEN 5 * with_text < pages AND 5 * with_image >= 4 * pages THEN 'NEEDS_OCR' WHEN chars = 0 AND with_image > 0 THEN 'NEEDS_OCR' ELSE 'PARSED' END AS state FROM d""")
def scanned_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of pages that need optical recognition: text without marks, images by page."""
    chars = F.length(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), "\\s", ""))
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("document"), F.when(F.col("page_id") % 3 == 0, 0).otherwise(chars).alias("chars"), (F.col("page_id") % 5 != 0).alias("image"))
    return gates.scan_states(rows, "document", "chars", "image")


_MARKET = """m AS (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) AS pos, CASE WHEN event_id % 29 = 0 THEN 'CLOSED' WHEN event_id % 61 = 0 THEN 'UNKNOWN' ELSE 'OPEN' END AS calendar, event_id % 43 <> 0 AS terminal, event_id % 59 <> 0 AS account, event_id % 17 <> 0 AS fresh,
    CASE WHEN event_id % 71 = 0 THEN 'STALE_DATA' WHEN event_id % 73 = 0 THEN 'DATA_FAILURE' END AS error, event_id % 23 = 0 AS require_validation, event_id % 3 = 0 AS validated FROM ticks)"""


@query(f"""
    WITH RECURSIVE {_MARKET}, w AS (SELECT symbol, event_id, pos, CAST('UNKNOWN' AS varchar) AS state, false AS opened FROM m WHERE false UNION ALL SELECT symbol, CAST(NULL AS bigint), CAST(0 AS bigint), 'UNKNOWN', false FROM (SELECT DISTINCT symbol FROM m) s
      UNION ALL SELECT symbol, event_id, pos, state, state = 'OPEN' OR (state = 'OPENING_VALIDATION' AND validated) FROM (SELECT m.symbol, m.event_id, m.pos, m.validated, CASE WHEN error = 'STALE_DATA' THEN 'UNKNOWN' WHEN error IS NOT NULL OR NOT terminal OR NOT account THEN 'DATA_ERROR' WHEN calendar = 'UNKNOWN' THEN 'UNKNOWN' WHEN calendar = 'CLOSED' AND fresh THEN 'OPENING_VALIDATION'
        WHEN calendar = 'CLOSED' THEN 'CLOSED' WHEN NOT fresh THEN 'UNKNOWN' WHEN w.opened AND NOT require_validation THEN 'OPEN' ELSE 'OPENING_VALIDATION' END AS state FROM w JOIN m ON m.symbol = w.symbol AND m.pos = w.pos + 1) n)
    SELECT symbol, event_id, state FROM w WHERE pos > 0""")
def market_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a market that opens only by validation; the oracle goes row by row."""
    k = F.col("event_id")
    rows = projection(spark, sf_dir, "ticks").select(
        "symbol", "us", k, F.when(k % 29 == 0, "CLOSED").when(k % 61 == 0, "UNKNOWN").otherwise("OPEN").alias("calendar"), (k % 43 != 0).alias("terminal"), (k % 59 != 0).alias("account"), (k % 17 != 0).alias("fresh"),
        F.when(k % 71 == 0, "STALE_DATA").when(k % 73 == 0, "DATA_FAILURE").alias("error"), (k % 23 == 0).alias("require_validation"), (k % 3 == 0).alias("validated"),
    )
    return gates.market_states(rows, "symbol", ["us", "event_id"], scans.span("us", 86_400_000_000)).select("symbol", "event_id", "state")


_PLAN = """p AS (SELECT event_id, bid, ask, event_id % 3 - 1 AS side, 1e2 + event_id % 50 AS entry, event_id % 400 AS held, (event_id % 21 - 10) / 1e1 AS mom, event_id % 11 / 1e1 AS per, event_id % 7 <> 0 AS live,
    CASE event_id % 5 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' WHEN 2 THEN 'BOTH' WHEN 3 THEN 'NONE' ELSE 'ODD' END AS dir, event_id % 13 AS vol, spread / 1e-2 AS sp FROM ticks)"""


@query(f"""
    WITH {_PLAN}, r AS (SELECT *, CASE WHEN side = 1 THEN (bid - entry) / 1e-1 WHEN side = -1 THEN (entry - ask) / 1e-1 END AS move FROM p),
    w AS (SELECT *, CASE WHEN NOT live THEN 'PLAN_EXPIRED_OR_MISMATCH' WHEN side <> 0 AND move <= -200 THEN 'STOP_LOSS' WHEN side <> 0 AND move >= 300 THEN 'TAKE_PROFIT' WHEN side <> 0 AND side * mom < 0 AND per >= 5e-1 THEN 'MOMENTUM_REVERSAL' WHEN side <> 0 AND held >= 300 THEN 'TIME_STOP' WHEN side <> 0 THEN 'POSITION_HELD'
      WHEN dir = 'NONE' THEN 'STRATEGIC_DIRECTION_NONE' WHEN dir = 'ODD' THEN 'DIRECTION_DISABLED' WHEN sp > 45e-1 THEN 'SPREAD_TOO_WIDE' WHEN vol < 1 OR vol > 11 THEN 'VOLATILITY_OUT_OF_BOUNDS' WHEN dir <> 'SHORT' AND mom >= 3e-1 AND per >= 4e-1 THEN 'LONG_CONFIRMATION' WHEN dir <> 'LONG' AND mom <= -3e-1 AND per >= 4e-1 THEN 'SHORT_CONFIRMATION' ELSE 'ENTRY_CONFIRMATION_PENDING' END AS why FROM r)
    SELECT event_id, why, CASE why WHEN 'PLAN_EXPIRED_OR_MISMATCH' THEN 'INVALIDATE' WHEN 'LONG_CONFIRMATION' THEN 'ENTER_LONG' WHEN 'SHORT_CONFIRMATION' THEN 'ENTER_SHORT' ELSE CASE WHEN why IN ('STOP_LOSS', 'TAKE_PROFIT', 'MOMENTUM_REVERSAL', 'TIME_STOP') THEN 'EXIT' ELSE 'NO_ACTION' END END AS act FROM w""")
def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan says to do at each tick, with or without a position."""
    k = F.col("event_id")
    direction = F.element_at(F.array(*[F.lit(x) for x in ("LONG", "SHORT", "BOTH", "NONE", "ODD")]), (k % 5 + 1).cast("int"))
    fixed = {"point": 0.1, "stop_points": 200, "target_points": 300, "time_stop_s": 300, "least_momentum": 0.3, "least_persistence": 0.4, "most_spread": 4.5, "least_volatility": 1, "most_volatility": 11}
    rows = projection(spark, sf_dir, "ticks").select(
        k, "bid", "ask", (k % 3 - 1).alias("position"), (100.0 + k % 50).alias("entry"), (k % 400).alias("held_s"), ((k % 21 - 10) / 10.0).alias("momentum"), (k % 11 / 10.0).alias("persistence"), (k % 7 != 0).alias("plan_active"),
        direction.alias("direction"), (k % 13).alias("volatility"), (F.col("spread") / 0.01).alias("spread_points"), *[F.lit(v).alias(n) for n, v in fixed.items()],
    )
    return gates.plan_action(rows).select("event_id", "why", "act")
