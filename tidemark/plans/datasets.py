"""The dataset build: pairing, the joined observations, and the whole of it. Oracles join many to many and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dataset, gates, intake
from tidemark.plans.registry import projection, query
from tidemark.session import Scratch, stored
from tidemark.sources import files

BASIS, HORIZON_S, AS_OF = "ANALYSIS_SNAPSHOT", 3600, 978_307_200_000_000
ORDERS = {"decisions": ["copy"], "records": ["copy"], "audits": ["copy"]}

#: Every evaluation against every snapshot of its decision, basis and horizon.
_PAIRED = """m AS (SELECT e.eval_id, s.fingerprint AS snapshot_fp, s.observed_us AS snapshot_us, row_number() OVER (PARTITION BY e.eval_id ORDER BY CASE WHEN s.fingerprint = e.fingerprint THEN 0 WHEN s.status = e.status THEN 1 ELSE 2 END,
      CASE WHEN e.known_us IS NULL OR s.observed_us IS NULL OR s.observed_us <= e.known_us THEN 0 ELSE 1 END, s.observed_us DESC NULLS LAST, s.fingerprint DESC) AS rn FROM ds_evals e JOIN ds_snapshots s ON s.decision_id = e.decision_id AND s.basis = e.basis AND s.horizon_s = e.horizon_s),
    paired AS (SELECT * FROM m WHERE rn = 1)"""
_JOINED = f"""{_PAIRED},
    d AS (SELECT decision_id, run_id, fp, count(*) AS n, min(analysis_us) AS analysis_us FROM ds_decisions GROUP BY 1, 2, 3), r AS (SELECT decision_id, run_id, fp, count(*) AS n FROM ds_records GROUP BY 1, 2, 3), a AS (SELECT decision_id, run_id, count(*) AS n FROM ds_audits GROUP BY 1, 2),
    k AS (SELECT DISTINCT decision_id, run_id, fp FROM ds_records),
    x AS (SELECT d.decision_id, d.run_id, d.fp, e.basis, e.horizon_s, e.fingerprint, e.status, e.eval_id, e.known_us FROM d JOIN ds_evals e ON e.decision_id = d.decision_id AND (e.run_id IS NULL OR e.run_id = d.run_id) AND (e.fp IS NULL OR e.fp = d.fp)),
    y AS (SELECT *, row_number() OVER (PARTITION BY decision_id, run_id, fp, basis, horizon_s ORDER BY fingerprint, eval_id) AS rn, count(*) OVER (PARTITION BY decision_id, run_id, fp, basis, horizon_s) AS n FROM x),
    z AS (SELECT y.decision_id, y.run_id, y.fp, y.basis, y.horizon_s, y.fingerprint, y.status, y.eval_id, y.known_us, y.n, CASE WHEN k.decision_id IS NOT NULL THEN p.snapshot_fp END AS snapshot_fp, CASE WHEN k.decision_id IS NOT NULL THEN p.snapshot_us END AS snapshot_us FROM y LEFT JOIN paired p ON p.eval_id = y.eval_id LEFT JOIN k ON k.decision_id = y.decision_id AND k.run_id = y.run_id AND k.fp = y.fp WHERE y.rn = 1),
    g AS (SELECT decision_id, run_id, fp, count(*) AS evaluations, string_agg(basis || ':' || horizon_s || '=' || eval_id || '@' || coalesce(snapshot_fp, '-'), ',' ORDER BY basis, horizon_s) AS listed, coalesce(string_agg(CASE WHEN n > 1 THEN decision_id || ':' || basis || ':' || horizon_s END, ',' ORDER BY basis, horizon_s), '') AS again FROM z GROUP BY 1, 2, 3),
    j AS (SELECT d.*, coalesce(r.n, 0) AS records, coalesce(a.n, 0) AS audits, d.n > 1 OR coalesce(r.n, 0) > 1 OR coalesce(a.n, 0) > 1 AS repeated FROM d LEFT JOIN r ON r.decision_id = d.decision_id AND r.run_id = d.run_id AND r.fp = d.fp LEFT JOIN a ON a.decision_id = d.decision_id AND a.run_id = d.run_id)"""


@query(f"WITH {_PAIRED} SELECT e.eval_id, snapshot_fp, snapshot_us FROM ds_evals e LEFT JOIN paired p ON p.eval_id = e.eval_id")
def snapshot_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that goes with each evaluation."""
    rows = dataset.paired(projection(spark, sf_dir, "ds_evals"), projection(spark, sf_dir, "ds_snapshots"), ["decision_id", *dataset.EVALUATION], "eval_id", 365 * dataset.DAY_US)
    return rows.select("eval_id", "snapshot_fp", "snapshot_us")


def _joined(spark: SparkSession, sf_dir: str, decisions: DataFrame | None = None) -> DataFrame:
    part = lambda name: projection(spark, sf_dir, f"ds_{name}")
    decisions = part("decisions") if decisions is None else decisions
    return dataset.joined(decisions, part("records"), part("evals"), part("snapshots"), part("audits"), ORDERS)


@query(f"""
    WITH {_JOINED} SELECT j.decision_id, j.run_id, j.n AS decisions, j.records, j.audits, coalesce(g.evaluations, 0) AS evaluations, g.listed, coalesce(g.again, '') AS duplicate_evaluations, j.repeated OR coalesce(g.again, '') <> '' AS duplicate FROM j LEFT JOIN g ON g.decision_id = j.decision_id AND g.run_id = j.run_id AND g.fp = j.fp""")
def joined_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with their records, audits and evaluations; what repeats is marked and multiplies nothing."""
    rows = _joined(spark, sf_dir)
    line = lambda e: F.concat(e["basis"], F.lit(":"), e["horizon_s"].cast("string"), F.lit("="), e["eval_id"].cast("string"), F.lit("@"), F.coalesce(e["snapshot_fp"], F.lit("-")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    listed = F.array_join(F.transform("evaluations", line), ",")
    return rows.select(
        "decision_id", "run_id", F.col("decision_n").alias("decisions"), zero("record_n").alias("records"), zero("audit_n").alias("audits"), zero(F.size("evaluations")).alias("evaluations"),
        listed.alias("listed"), F.array_join("duplicate_evaluations", ",").alias("duplicate_evaluations"), "duplicate",
    )


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Examples with their split and (decision_id, reasons) of what is left out, from three sources of decisions.

    One source is a copy of another and one lacks a column: both are left out by name, the others stay.
    """
    decisions = projection(spark, sf_dir, "ds_decisions")
    half = lambda k: decisions.where(F.pmod(F.xxhash64("decision_id"), F.lit(2)) == k)
    readers = {"a": lambda: half(0), "b": lambda: half(1), "c": lambda: half(1), "d": lambda: decisions.drop("fp")}
    united, bad, _ = dataset.united(readers, decisions.columns)
    rows = dataset.evaluated(_joined(spark, sf_dir, united.drop("source")), BASIS, HORIZON_S)
    c = F.col
    wide = rows.select(
        "decision_id", "run_id", "fp", "duplicate", "decision.analysis_us", "decision.completed_us", "decision.reference_us", "decision.normalization", "decision.action", "decision.context", "decision.schema_version", "decision.artifacts",
        c("record.tier").alias("tier"), F.coalesce("record.provenance_valid", F.lit(False)).alias("provenance_valid"), c("audit").isNotNull().alias("audit"), c("audit.integrity").alias("integrity"), c("audit.audit_status").alias("audit_status"),
        F.sequence(F.lit(0), F.coalesce("audit.refs", F.lit(0))).alias("available"), F.lit(True).alias("source_available"), c("eval").isNotNull().alias("evaluated"), c("eval.basis").alias("eval_basis"), c("eval.horizon_s").alias("eval_horizon_s"), c("eval.status").alias("eval_status"),
        F.lit(True).alias("eval_context_ok"), c("eval.snapshot_fp").isNotNull().alias("eval_provenance_valid"), c("eval.known_us").alias("known_us"), c("decision.analysis_us").alias("entry_us"), (c("decision.analysis_us") + 3_600_000_000).alias("target_us"), (c("decision.analysis_us") + 3_660_000_000).alias("observed_us"),
    ).withColumns({"used": F.filter("available", lambda x: x % 2 == 0), "rejected": F.filter("available", lambda x: x % 2 == 1)})
    judged = stored(gates.dataset_reasons(wide, BASIS, HORIZON_S, AS_OF).select("decision_id", "run_id", "fp", "analysis_us", "action", "eval_basis", "eval_horizon_s", "eval_status", "reasons"))
    examples, left = dataset.classified(judged, ["fp", "decision_id", "eval_basis", "eval_horizon_s"], ["run_id"], "analysis_us", "decision_id")
    return examples, left.unionByName(bad.withColumnRenamed("reason", "reasons")) if bad is not None else left


_RULES = f"""{_JOINED},
    dd AS (SELECT * FROM ds_decisions WHERE copy = 0), rr AS (SELECT * FROM ds_records WHERE copy = 0), aa AS (SELECT * FROM ds_audits WHERE copy = 0),
    c AS (SELECT z.*, row_number() OVER (PARTITION BY decision_id, run_id, fp ORDER BY CASE WHEN basis = '{BASIS}' AND horizon_s = {HORIZON_S} THEN 0 ELSE 1 END, basis, horizon_s) AS first FROM z),
    o AS (SELECT dd.*, j.repeated OR coalesce(c.n, 0) > 1 AS duplicate, rr.tier, coalesce(rr.provenance_valid, false) AS proven, aa.decision_id IS NOT NULL AS audited, coalesce(aa.integrity = 'COMPLETE', false) AS whole, aa.audit_status, c.decision_id IS NOT NULL AS evaluated, c.basis, c.horizon_s, c.status, c.snapshot_fp, c.known_us FROM dd
      JOIN j ON j.decision_id = dd.decision_id AND j.run_id = dd.run_id AND j.fp = dd.fp LEFT JOIN rr ON rr.decision_id = dd.decision_id AND rr.run_id = dd.run_id AND rr.fp = dd.fp LEFT JOIN aa ON aa.decision_id = dd.decision_id AND aa.run_id = dd.run_id LEFT JOIN c ON c.decision_id = dd.decision_id AND c.run_id = dd.run_id AND c.fp = dd.fp AND c.first = 1),
    q AS (SELECT decision_id, run_id, analysis_us, list_filter([CASE WHEN tier IS DISTINCT FROM 'A' THEN 'UNTRUSTED_TIER' END, CASE WHEN context <> 'COMPLETE' OR NOT whole OR NOT artifacts THEN 'DECISION_CONTEXT_INCOMPLETE' END,
      CASE WHEN completed_us IS NULL OR completed_us < analysis_us OR reference_us < analysis_us OR reference_us < completed_us OR greatest(analysis_us, completed_us, coalesce(reference_us, 0)) > {AS_OF} OR (evaluated AND (coalesce(known_us, 0) > {AS_OF} OR analysis_us + 3660000000 > {AS_OF})) THEN 'TEMPORAL_INVALID' END,
      CASE WHEN evaluated AND NOT (basis = '{BASIS}' AND horizon_s = {HORIZON_S} AND status = 'COMPLETE') THEN 'OUTCOME_INELIGIBLE' END, CASE WHEN NOT evaluated THEN 'OUTCOME_UNAVAILABLE' END, CASE WHEN normalization <> 'NORMALIZED' OR action IS NULL THEN 'NORMALIZATION_FAILED' END, CASE WHEN NOT audited OR audit_status <> 'VALID' THEN 'CITATION_INVALID' END,
      CASE WHEN NOT whole THEN 'EVIDENCE_INCOMPLETE' END, CASE WHEN schema_version LIKE 'unsupported%' THEN 'SCHEMA_UNSUPPORTED' END, CASE WHEN NOT proven OR (evaluated AND snapshot_fp IS NULL) THEN 'PROVENANCE_INCOMPLETE' END, CASE WHEN duplicate THEN 'DUPLICATE' END], lambda x: x IS NOT NULL) AS reasons FROM o)"""


@query(f"WITH {_RULES} SELECT array_to_string(reasons, ',') AS reasons, count(*) AS n FROM q GROUP BY 1 UNION ALL SELECT 'source:c DUPLICATE', 1 UNION ALL SELECT 'source:d SOURCE_INTEGRITY_FAILED', 1")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many decisions became examples (no reason), and how many were left out for which reasons.

    Examples are written as a generation, read back and held against their manifest before they count.
    """
    examples, left = build(spark, sf_dir)
    with Scratch(spark) as scratch:
        rows = stored(intake.canonical(examples, ["decision_id", "eval_basis", "eval_horizon_s"], {"decision": ["decision_id", "run_id", "fp"], "outcome": ["action", "eval_status"]}, "split"))
        files.write_generation(rows, f"{scratch.top}/generation")
        again = spark.read.schema(rows.schema).json(f"{scratch.top}/generation")
        files.verified(rows, again)
        n = again.count()
    out = left.select(F.when(F.col("decision_id").startswith("source:"), F.concat_ws(" ", "decision_id", "reasons")).otherwise(F.col("reasons")).alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))
    return out.unionByName(spark.createDataFrame([("", n)], "reasons string, n bigint")) if n else out
