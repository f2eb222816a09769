"""Gates: rows are never dropped silently, each gets the reason that fails it, or all of them.

A *chain* names the first rule that fails; a *set* lists every rule that fails, in the order given.
Conditions that come out null count as not met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scans

TIERS = ("A", "B", "C")
DATASET_REASONS = (
    "UNTRUSTED_TIER", "DECISION_CONTEXT_INCOMPLETE", "TEMPORAL_INVALID", "OUTCOME_INELIGIBLE", "OUTCOME_UNAVAILABLE", "NORMALIZATION_FAILED",
    "CITATION_INVALID", "EVIDENCE_INCOMPLETE", "SCHEMA_UNSUPPORTED", "PROVENANCE_INCOMPLETE", "DUPLICATE", "SOURCE_INTEGRITY_FAILED",
)


def chain(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit(None).cast("string"))


def every(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def source_eligibility(context: Column, normalization: Column, action: Column, at_us: Column) -> Column:
    """Why a decision can't be evaluated, the first of four rules, or ELIGIBLE_SOURCE_CONTEXT."""
    rules = [
        ("DECISION_CONTEXT_INCOMPLETE", ~context.eqNullSafe("COMPLETE")), ("NORMALIZATION_FAILED", ~normalization.eqNullSafe("NORMALIZED")),
        ("ACTION_UNAVAILABLE", ~F.coalesce(action.isin("BUY", "SELL", "HOLD"), F.lit(False))), ("ANALYSIS_TIMESTAMP_INVALID", at_us.isNull()),
    ]
    return F.coalesce(chain(rules), F.lit("ELIGIBLE_SOURCE_CONTEXT"))


def search_gate(
    rows: DataFrame, symbol: str | None = None, profile: str | None = None, timeframe: str | None = None, tiers: tuple[str, ...] = ("A", "B"), action: str | None = None, as_of_us: int | None = None
) -> DataFrame:
    """The rows with ``reason``, null where they may be compared.

    ``tombstoned`` is 0 or 1 (anything else is damage), ``aliases`` and ``current_aliases`` count
    what names a record, now and ever. What passes the chain must also be of the cohort, schema and
    extractor of the first record (by id) that passes it.
    """
    if "C" in tiers:
        raise ValueError("records of tier C are for diagnosis only")
    if bad := set(tiers) - set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(bad)}")
    damaged = F.col("tombstoned").isNull() | ~F.col("tombstoned").isin(0, 1) | (F.coalesce("aliases", F.lit(0)) <= 0)
    gone = (F.col("tombstoned") != 0) | (F.coalesce("current_aliases", F.lit(0)) <= 0)
    differs = lambda column, wanted: F.lit(False) if wanted is None else ~F.col(column).eqNullSafe(wanted)
    late = lambda c: F.col(c).isNull() | (F.col(c) >= as_of_us)
    reason = chain([
        ("tombstone", damaged), ("symbol", differs("symbol", symbol)), ("profile", differs("profile", profile)), ("timeframe", differs("timeframe", timeframe)),
        ("trust_tier", F.col("tier").isNull() | ~F.col("tier").isin(*tiers)), ("provenance", ~F.coalesce(F.col("accepted") & ~F.col("conflict") & F.col("provenance_valid"), F.lit(False))),
        ("action", differs("action", action)), ("tombstone", gone if as_of_us is None else F.lit(False)), ("as_of", F.lit(False) if as_of_us is None else late("snapshot_us") | late("completed_us")),
    ])
    judged = rows.withColumn("reason", reason)
    lead = judged.where("reason is null").agg(F.min_by(F.struct("cohort", "schema_version", "extractor_version"), "experience_id").alias("lead"))
    both = judged.crossJoin(F.broadcast(lead))  # one row
    other = [(name, ~F.col(c).eqNullSafe(F.col(f"lead.{c}"))) for name, c in (("cohort", "cohort"), ("feature_schema", "schema_version"), ("feature_extractor", "extractor_version"))]
    return both.withColumn("reason", F.coalesce("reason", chain(other))).drop("lead")


def outcome_exclusions(requested: DataFrame, experiences: DataFrame, snapshots: DataFrame, basis: str, horizon_s: int, as_of_us: int | None = None, tiers: tuple[str, ...] = ("A",)) -> DataFrame:
    """(experience_id, reason, fingerprint): why a requested outcome can't be counted, null where it can.

    Of the snapshots of the basis and horizon the one known last is judged; with ``as_of_us`` only
    those known by then count, and a complete one only if its market observation was there too.
    """
    exact = (F.col("basis") == basis) & (F.col("horizon_s") == horizon_s)
    known = exact if as_of_us is None else exact & (F.col("available_us") <= as_of_us) & ((F.col("status") != "COMPLETE") | F.coalesce(F.col("observed_us") <= as_of_us, F.lit(False)))
    row = F.struct("status", "available_us", "context_ok", "reference_status", "net", "action", "hold_cost", "fingerprint")
    order = F.struct(F.coalesce("available_us", F.lit(-(1 << 62))), "fingerprint")
    best = snapshots.groupBy("experience_id").agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.max_by(F.when(known, row), F.when(known, order)).alias("s"))
    rows = requested.join(experiences.select("experience_id", "tier", F.lit(True).alias("found")), "experience_id", "left").join(best, "experience_id", "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    reason = chain([
        ("EXPERIENCE_NOT_FOUND", F.col("found").isNull()), ("EVALUATION_NOT_AVAILABLE", F.coalesce("n", F.lit(0)) == 0), ("BASIS_OR_HORIZON_MISMATCH", F.col("n_exact") == 0),
        ("EVALUATION_NOT_YET_AVAILABLE", F.col("s").isNull()), ("TRUST_TIER_INVALID", F.col("tier").isNull() | ~F.col("tier").isin(*TIERS)), ("TRUST_TIER_NOT_ALLOWED", ~F.col("tier").isin(*tiers)),
    ])
    state = F.when(F.col("s.status") != "COMPLETE", F.when(F.col("s.status") == "", "EVALUATION_STATUS_UNKNOWN").otherwise(F.col("s.status"))).when(F.col("s.status").isNull(), "EVALUATION_STATUS_UNKNOWN")
    last = chain([
        ("EVALUATION_AVAILABILITY_UNKNOWN", F.col("s.available_us").isNull()), ("SOURCE_CONTEXT_INELIGIBLE", ~F.col("s.context_ok").eqNullSafe(1)),
        ("REFERENCE_UNAVAILABLE", F.lit(basis == "DECISION_REFERENCE") & (F.coalesce("s.reference_status", F.lit("AVAILABLE")) != "AVAILABLE")),
        ("REQUIRED_FIELD_MISSING_OR_NONFINITE", ~finite("s.net") | ((F.col("s.action") == "HOLD") & ~finite("s.hold_cost"))), ("SELECTED_ACTION_INVALID", ~F.coalesce(F.col("s.action").isin("BUY", "SELL", "HOLD"), F.lit(False))),
    ])
    why = F.coalesce(reason, state, last)
    return rows.select("experience_id", why.alias("reason"), F.when(why.isNull(), F.col("s.fingerprint")).alias("fingerprint"))


def trust_tier(rows: DataFrame, least_features: int = 8) -> DataFrame:
    """The rows with ``tier`` and ``reasons``: C for what damages a record, B for what only limits it."""
    order = F.col("completed_us") < F.col("snapshot_us")
    rules = [
        ("EXECUTED", F.coalesce("executed", F.lit(0)) != 0), ("NORMALIZATION_FAILED", ~F.col("normalization").eqNullSafe("NORMALIZED")), ("CONTEXT_INCOMPLETE", ~F.col("context").eqNullSafe("COMPLETE")),
        ("ACTION_INVALID", ~F.coalesce(F.col("action").isin("BUY", "SELL", "HOLD"), F.lit(False))), ("COMPLETION_UNAVAILABLE", F.col("completed_us").isNull()),
        ("TEMPORAL_INVALID", (F.col("completed_us").isNotNull() & (F.col("snapshot_us").isNull() | order)) | (F.col("reference_status") == "INVALID_TEMPORAL")),
        ("REFERENCE_STATUS_INVALID", ~F.coalesce(F.col("reference_status").isin("AVAILABLE", "UNAVAILABLE", "INVALID_TEMPORAL"), F.lit(False))),
        ("MARKET_FEATURES_INSUFFICIENT", F.col("features") < least_features), ("PROVENANCE_INVALID", ~F.col("provenance_valid")), ("QUOTE_INVALID", ~F.col("quote_valid")),
    ]
    partial = F.col("features") < F.col("all_features")
    found = every(rules)
    harmless = F.array(F.lit("COMPLETION_UNAVAILABLE"))
    tier = F.when(F.size(F.array_except(found, harmless)) > 0, "C").when((F.size(found) > 0) | partial, "B").otherwise("A")
    return rows.withColumn("tier", tier).withColumn("reasons", F.when(F.col("tier") == "B", F.concat(found, F.when(partial, F.array(F.lit("FEATURES_PARTIAL"))).otherwise(F.array().cast("array<string>")))).otherwise(found))


def dataset_reasons(rows: DataFrame, basis: str, horizon_s: int, as_of_us: int | None = None) -> DataFrame:
    """The rows with ``reasons``, all that keep an observation out of a dataset, in a fixed order."""
    c = F.col
    true = lambda x: F.coalesce(x, F.lit(False))
    whole = true(c("audit") & (c("integrity") == "COMPLETE"))
    later = lambda *names: F.lit(False) if as_of_us is None else true(F.greatest(*[F.coalesce(c(n), F.lit(-(1 << 62))) for n in names], F.lit(-(1 << 62))) > as_of_us)
    partition = ~F.arrays_overlap("used", "rejected") & (F.size(F.array_except(F.array_union("used", "rejected"), "available")) == 0) & (F.size(F.array_except("available", F.array_union("used", "rejected"))) == 0)
    temporal = (
        c("completed_us").isNull() | true(c("completed_us") < c("analysis_us")) | true(c("reference_us") < c("analysis_us")) | true(c("reference_us") < c("completed_us"))
        | later("analysis_us", "completed_us", "reference_us") | (c("evaluated") & (later("known_us", "entry_us", "observed_us", "target_us") | true(c("target_us") < c("analysis_us")) | true(c("entry_us") > c("target_us")) | true(c("observed_us") < c("entry_us"))))
    )
    tests = {
        "UNTRUSTED_TIER": ~c("tier").eqNullSafe("A"),
        "DECISION_CONTEXT_INCOMPLETE": ~c("context").eqNullSafe("COMPLETE") | ~whole | ~true(c("artifacts")),
        "TEMPORAL_INVALID": temporal,
        "OUTCOME_INELIGIBLE": c("evaluated") & ~true((c("eval_basis") == basis) & (c("eval_horizon_s") == horizon_s) & (c("eval_status") == "COMPLETE") & c("eval_context_ok")),
        "OUTCOME_UNAVAILABLE": ~c("evaluated"),
        "NORMALIZATION_FAILED": ~true((c("normalization") == "NORMALIZED") & c("action").isin("BUY", "SELL", "HOLD")),
        "CITATION_INVALID": ~true(c("audit") & (c("audit_status") == "VALID")) | (true(c("audit")) & ~true(partition)),
        "EVIDENCE_INCOMPLETE": ~whole,
        "SCHEMA_UNSUPPORTED": true(c("schema_version").startswith("unsupported")),
        "PROVENANCE_INCOMPLETE": ~true(c("provenance_valid")) | (c("evaluated") & ~true(c("eval_provenance_valid"))),
        "DUPLICATE": true(c("duplicate")),
        "SOURCE_INTEGRITY_FAILED": ~F.coalesce(c("source_available"), F.lit(True)),
    }
    return rows.withColumn("reasons", every([(name, tests[name]) for name in DATASET_REASONS]))


def latest_eligible(decisions: DataFrame, runs: DataFrame | None) -> DataFrame:
    """The newest decision of each symbol that may be acted on.

    One to hold is always eligible; a directional one needs a run that ended well, in time and with a
    reference price. Without runs only those to hold are.
    """
    ready = decisions.where("executed = 0 and normalization = 'NORMALIZED' and context = 'COMPLETE'")
    hold = ready.where("action = 'HOLD'")
    if runs is not None:
        good = runs.where("status in ('SUCCEEDED', 'SUCCEEDED_SLOW') and context = 'COMPLETE' and normalization = 'NORMALIZED' and reference_status = 'AVAILABLE' and stale = 0 and budget_s > 0")
        side = ready.where("action in ('BUY', 'SELL') and reference_status = 'AVAILABLE' and latency_s is not null")
        fresh = side.join(good.select("decision_id", "run_id", "budget_s"), ["decision_id", "run_id"]).where("latency_s <= budget_s")
        hold = hold.unionByName(fresh.select(*decisions.columns).distinct())
    row = F.struct(*[F.col(x) for x in decisions.columns])
    best = hold.groupBy(F.upper("symbol").alias("of")).agg(F.max_by(row, F.struct("us", "decision_id")).alias("d"))
    return best.select("d.*")


def open_markets(markets: DataFrame, now_us: int) -> DataFrame:
    """Markets that are open, resolve in the future and carry prices and outcomes (JSON lists).

    Without an end a market counts as open-ended.
    """
    some = lambda c: F.size(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))) > 0
    return markets.where(~F.coalesce("closed", F.lit(False)) & F.coalesce(F.col("end_us") >= now_us, F.lit(True)) & some("prices") & some("outcomes"))


def risk_verdict(rows: DataFrame, stale_s: float, spread: float, slippage: float, daily_loss: float, drawdown: float, losses: int, exposure: float, enforce_losses: bool = True) -> DataFrame:
    """The rows with ``code``, the first limit that an entry breaks; what is no entry passes."""
    entry = F.col("action").isin("ENTER_LONG", "ENTER_SHORT")
    outside = (F.size("sessions") > 0) & ~F.array_contains(F.transform("sessions", lambda s: F.upper(s)), F.upper("session"))
    loss = F.lit(enforce_losses)
    code = chain([
        ("PLAN_EXPIRED", F.col("expired")), ("NON_ENTRY", ~entry), ("SESSION_LIMIT", outside), ("STALE_TICK", F.col("age_s") > stale_s), ("SPREAD_LIMIT", F.col("spread_points") > spread),
        ("SLIPPAGE_LIMIT", F.col("slippage_points") > slippage), ("DAILY_LOSS_LIMIT", loss & (F.col("daily_loss") >= daily_loss)), ("DRAWDOWN_LIMIT", loss & (F.col("drawdown") >= drawdown)),
        ("CONSECUTIVE_LOSS_LIMIT", loss & (F.col("losses_in_row") >= losses)), ("EXPOSURE_LIMIT", F.col("exposure") >= exposure),
    ])
    return rows.withColumn("code", F.coalesce(code, F.lit("ACCEPTED"))).withColumn("allowed", F.col("code").isin("ACCEPTED", "NON_ENTRY"))


def scan_states(pages: DataFrame, document: str, text_chars: str, has_image: str, least_chars: int = 64) -> DataFrame:
    """(document, pages, with_text, with_image, state): documents that need optical recognition.

    Few pages with text and many with images, or images and no text at all.
    """
    one = pages.groupBy(document).agg(F.count("*").alias("pages"), F.count_if(F.col(text_chars) >= least_chars).alias("with_text"), F.count_if(has_image).alias("with_image"), F.sum(text_chars).alias("chars"))
    scanned = ((F.col("with_text") / F.col("pages") < 0.2) & (F.col("with_image") / F.col("pages") >= 0.8)) | ((F.col("chars") == 0) & (F.col("with_image") > 0))
    return one.select(document, "pages", "with_text", "with_image", F.when(scanned, "NEEDS_OCR").otherwise("PARSED").alias("state"))


def losses_in_row(trades: DataFrame, by: list[str], order: list[str], pnl: str = "pnl") -> DataFrame:
    """The trades with how many losing ones came right before each, and what was lost on them by group."""
    line = Window.partitionBy(*by).orderBy(*order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce(F.sum(F.when(F.col(pnl) >= 0, 1).otherwise(0)).over(before), F.lit(0))
    marked = trades.withColumn("run", wins)
    lost = F.coalesce(F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0)).over(before), F.lit(0.0))
    count = F.sum(F.when(F.col(pnl) < 0, 1).otherwise(0)).over(Window.partitionBy(*by, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("daily_loss", lost).withColumn("losses_in_row", F.coalesce(count, F.lit(0))).drop("run")


def plan_action(rows: DataFrame) -> DataFrame:
    """The rows with ``act`` and ``why``: what a plan says to do at a tick, by its stop, target and time.

    ``position`` is 1, -1 or 0 with ``entry`` and ``held_s``; ``plan_active`` says that a plan of the
    symbol holds at the tick, ``direction`` is LONG, SHORT, BOTH or NONE.
    """
    c = F.col
    move = c("position") * (F.when(c("position") > 0, c("bid")).otherwise(c("ask")) - c("entry")) / c("point")
    leave = chain([
        ("POSITION_PRICE_UNAVAILABLE", c("entry").isNull() | (c("entry") <= 0)), ("STOP_LOSS", move <= -c("stop_points")), ("TAKE_PROFIT", move >= c("target_points")),
        ("MOMENTUM_REVERSAL", (c("position") * c("momentum") < 0) & (c("persistence") >= 0.5)), ("TIME_STOP", c("held_s") >= c("time_stop_s")),
    ])
    confirmed = lambda side, names: c("direction").isin(*names) & (side * c("momentum") >= c("least_momentum")) & (c("persistence") >= c("least_persistence"))
    enter = chain([
        ("STRATEGIC_DIRECTION_NONE", c("direction") == "NONE"), ("DIRECTION_DISABLED", ~c("direction").isin("LONG", "SHORT", "BOTH")), ("SPREAD_TOO_WIDE", c("spread_points") > c("most_spread")),
        ("VOLATILITY_OUT_OF_BOUNDS", ~c("volatility").between(c("least_volatility"), c("most_volatility"))), ("LONG_CONFIRMATION", confirmed(1, ("LONG", "BOTH"))), ("SHORT_CONFIRMATION", confirmed(-1, ("SHORT", "BOTH"))),
    ])
    why = F.when(~c("plan_active"), "PLAN_EXPIRED_OR_MISMATCH").when(c("position") != 0, F.coalesce(leave, F.lit("POSITION_HELD"))).otherwise(F.coalesce(enter, F.lit("ENTRY_CONFIRMATION_PENDING")))
    act = F.when(F.col("why") == "PLAN_EXPIRED_OR_MISMATCH", "INVALIDATE").when(F.col("why") == "LONG_CONFIRMATION", "ENTER_LONG").when(F.col("why") == "SHORT_CONFIRMATION", "ENTER_SHORT")
    act = act.when((F.col("position") != 0) & (F.col("why") != "POSITION_HELD"), "EXIT").otherwise("NO_ACTION")
    return rows.withColumn("why", why).withColumn("act", act)


def market_states(rows: DataFrame, by: str, order: list[str], bucket: Column) -> DataFrame:
    """The rows with ``state``, as a market that opens only by validation goes through them.

    ``calendar`` is OPEN, CLOSED or UNKNOWN; ``error`` names a fault, ``unknown`` those of the
    calendar or of stale data; ``validated`` says that a validation pending after the row succeeded.
    It stays open from a validation on while each row is open, healthy and fresh and asks for none:
    so it is open if the last validation is later than the last row that isn't. No row waits for the
    state of the one before, and the two latest places are carried over the buckets of the order.
    """
    c = F.col
    fault = c("error").isNotNull()
    well = ~fault & c("terminal") & c("account")
    open_row = well & (c("calendar") == "OPEN") & c("fresh")
    steady = open_row & ~c("require_validation")
    valid = (open_row | (well & (c("calendar") == "CLOSED") & c("fresh"))) & c("validated")
    place = F.struct(*order)
    known = rows.withColumn("steady", F.coalesce(steady, F.lit(False))).withColumn("valid", F.coalesce(valid, F.lit(False)))
    latest = {"last_valid": F.when(c("valid"), place), "last_break": F.when(~c("steady") & ~c("valid"), place)}
    numbered = scans.greatest_before(known, [by], order, bucket, latest)
    was_open = c("last_valid").isNotNull() & (c("last_break").isNull() | (c("last_break") < c("last_valid")))
    state = (
        F.when(fault, F.when(c("error").isin("CALENDAR_UNAVAILABLE", "STALE_DATA"), "UNKNOWN").otherwise("DATA_ERROR")).when(~c("terminal") | ~c("account"), "DATA_ERROR")
        .when(c("calendar") == "CLOSED", F.when(c("fresh"), "OPENING_VALIDATION").otherwise("CLOSED")).when((c("calendar") == "OPEN") & c("fresh"), F.when(was_open & c("steady"), "OPEN").otherwise("OPENING_VALIDATION")).otherwise("UNKNOWN")
    )
    return numbered.withColumn("state", state).drop("last_valid", "last_break", "steady", "valid")
