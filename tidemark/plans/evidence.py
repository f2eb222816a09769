"""Evidence assembly, eligibility, integrity and projections for training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import corpus, evidence, grounding, similarity
from tidemark.operators.asof import asof
from tidemark.plans.registry import projection, query, statement
from tidemark.session import table

statement("trade_evidence_assembly", """
    WITH fills AS (SELECT l_orderkey, count(*) AS fills, sum(l_extendedprice * (1 - l_discount)) AS net, max(l_tax) AS slip FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'NO_ACCOUNT' WHEN fills IS NULL THEN 'NO_FILLS' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN slip > 7e-2 THEN 'SLIPPAGE_UNKNOWN' END AS quarantine,
      CASE WHEN fills >= 4 AND slip <= 5e-2 THEN 'A' WHEN fills IS NOT NULL THEN 'B' ELSE 'C' END AS tier, coalesce(fills, 0) AS fills, round(coalesce(net, 0e0), 4) AS net FROM orders LEFT JOIN fills ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
statement("exclusion_audit", """
    WITH r AS (SELECT decision_id, symbol, 'MISSING_ANCHOR' AS reason FROM decisions WHERE anchor_us IS NULL UNION ALL SELECT decision_id, symbol, 'SYMBOL' FROM decisions WHERE symbol = 7 UNION ALL SELECT decision_id, symbol, 'SPREAD' FROM decisions WHERE ask - bid > 45e-3 UNION ALL SELECT decision_id, symbol, 'NON_DIRECTIONAL' FROM decisions WHERE action = 'HOLD')
    SELECT reason, symbol, count(*) AS n, count(DISTINCT decision_id) AS decisions FROM r GROUP BY reason, symbol""")
statement("context_integrity", """
    SELECT c.conv_id, r.role AS required_role, count(t.turn) AS turns, CAST(coalesce(sum(length(t.text)), 0) AS bigint) AS chars FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT 'user' AS role UNION ALL SELECT 'assistant' UNION ALL SELECT 'system') r
    LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.role = r.role GROUP BY c.conv_id, r.role""")
statement("reconciled_positions", """
    SELECT o_orderkey, round(o_totalprice, 2) AS owned, round(deals, 2) AS deals, CASE WHEN deals IS NULL THEN 'MISSING' WHEN abs(o_totalprice - deals) <= 1e-2 * o_totalprice THEN 'MATCHED' ELSE 'MISMATCH' END AS verdict
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS deals FROM lineitem GROUP BY l_orderkey) d ON o_orderkey = l_orderkey""")
statement("concept_conflicts", "SELECT p_brand, count(*) AS rules, count(DISTINCT p_type) AS signatures, count(DISTINCT p_type) > 1 AS conflicting, min(p_partkey) AS anchor FROM part GROUP BY p_brand")
statement("specs_by_semantic_key", "SELECT p_type, p_size, p_partkey, evidence FROM (SELECT p_type, p_size, p_partkey, count(*) OVER (PARTITION BY p_type, p_size) AS evidence, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) q WHERE rn = 1")


@query("""
    SELECT p.p_partkey, v.name, round(p.p_retailprice * v.stop, 4) AS stop, round(p.p_retailprice * v.target, 4) AS target FROM part p
    CROSS JOIN (SELECT 'tighter_stop' AS name, 8e-1 AS stop, 1e0 AS target UNION ALL SELECT 'wider_stop', 12e-1, 1e0 UNION ALL SELECT 'nearer_target', 1e0, 8e-1 UNION ALL SELECT 'further_target', 1e0, 12e-1 UNION ALL SELECT 'both_tight', 8e-1, 8e-1 UNION ALL SELECT 'both_wide', 12e-1, 12e-1) v""")
def candidate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six variants of every part."""
    factors = [("tighter_stop", 0.8, 1.0), ("wider_stop", 1.2, 1.0), ("nearer_target", 1.0, 0.8), ("further_target", 1.0, 1.2), ("both_tight", 0.8, 0.8), ("both_wide", 1.2, 1.2)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("stop"), F.lit(b).alias("target")) for n, a, b in factors)))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", each.alias("v"))
    return parts.select("p_partkey", "v.name", *(F.round(F.col("p_retailprice") * F.col(f"v.{c}"), 4).alias(c) for c in ("stop", "target")))


statement("multi_timeframe_snapshot", """
    SELECT symbol, 'M15' AS frame, count(DISTINCT us - us % 900000000) AS bars, max_by(mid, us) AS last_mid FROM ticks GROUP BY symbol UNION ALL SELECT symbol, 'H1', count(DISTINCT us - us % 3600000000), max_by(mid, us) FROM ticks GROUP BY symbol
    UNION ALL SELECT symbol, 'D1', count(DISTINCT us - us % 86400000000), max_by(mid, us) FROM ticks GROUP BY symbol""")
statement("removed_resources", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
statement("context_budget", """
    SELECT conv_id, turn, n_words, running <= 200 AS kept FROM (SELECT conv_id, turn, n_words, sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM (SELECT conv_id, turn, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS bigint) AS n_words FROM conversations) w) q""")
statement("health_lattice", """
    SELECT agent, CASE WHEN failed3 = 3 THEN 'DEGRADED' WHEN p95 >= 8e-1 * 4e5 OR failed3 > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM (SELECT agent, sum(CASE WHEN rn <= 3 AND status = 'FAILED' THEN 1 ELSE 0 END) AS failed3, @d(latency, 0.95) AS p95
      FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY us DESC, decision_id DESC) AS rn FROM runs) r GROUP BY agent) q""")
statement("feed_health", "SELECT symbol, max(us) AS last_us, CASE WHEN 1706659200000000 - max(us) > 43200000000 THEN 'DEGRADED' WHEN 1706659200000000 - max(us) < -2000000 THEN 'DEGRADED' ELSE 'OK' END AS health FROM ticks GROUP BY symbol")
statement("promotion_history", "SELECT agent, max(CASE WHEN status = 'SUCCEEDED' THEN decision_id END) AS last_promotion, max(CASE WHEN status = 'FAILED' THEN decision_id END) AS last_rollback, count(*) AS experiments FROM runs GROUP BY agent")
statement("evaluation_summary", "SELECT part % 11 AS candidate, flag AS reason, state AS status, count(*) AS n FROM evals GROUP BY part % 11, flag, state")


@query("SELECT conv_id, turn, CAST(i - 1 AS int) AS i, s AS sentence FROM (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|[\\r\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations) p) q")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sentences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("""
    WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s.,!?|]+'), lambda w: length(w) > 3)) AS w FROM conversations)
    SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) >= 2 AS grounded FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'""")
def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer shares two content words with the turn it follows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(f"array_distinct(filter({corpus.tokens('text')}, w -> length(w) > 3))").alias("w"))
    cited = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("cited"))
    return rows.where("role = 'assistant'").join(cited, ["conv_id", "turn"]).select("conv_id", "turn", (F.size(F.array_intersect("w", "cited")) >= 2).alias("grounded"))


_STOP, _META, _NEG = (", ".join(f"'{w}'" for w in x) for x in (grounding.STOP, grounding.META, grounding.NEGATIONS))
_OPPOSED = " OR ".join(f"(len(list_intersect(x.w, [{a}])) > 0 AND len(list_intersect(y.w, [{b}])) > 0) OR (len(list_intersect(x.w, [{b}])) > 0 AND len(list_intersect(y.w, [{a}])) > 0)" for a, b in ((", ".join(f"'{w}'" for w in side) for side in pair) for pair in grounding.OPPOSITES))
_SAID = "s || CASE i % 5 WHEN 0 THEN ' not' WHEN 1 THEN ' higher' WHEN 2 THEN ' lower' ELSE '' END"


@query(f"""
    WITH s AS (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS k FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|[\\r\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant') p),
    c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i, s FROM s), d AS (SELECT conv_id, turn, i, {_SAID} AS t FROM c),
    w AS (SELECT conv_id, turn, i, list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), lambda x: x NOT IN ({_STOP})) AS all_w FROM d), v AS (SELECT *, list_filter(all_w, lambda x: x NOT IN ({_NEG})) AS w, len(list_intersect(all_w, [{_NEG}])) > 0 AS neg FROM w),
    b AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN ({_STOP})) AS w FROM conversations),
    u AS (SELECT v.conv_id, min(v.i) AS i FROM v LEFT JOIN b ON b.conv_id = v.conv_id AND b.turn = v.turn - 1 WHERE b.turn IS NULL OR (len(list_intersect(v.all_w, b.w)) < 2 AND len(list_intersect(v.all_w, [{_META}])) = 0) GROUP BY 1),
    g AS (SELECT v.conv_id, min(v.i) AS i FROM v LEFT JOIN b ON b.conv_id = v.conv_id AND b.turn = v.turn - 1 WHERE b.turn IS NULL GROUP BY 1),
    p AS (SELECT x.conv_id, min(x.i * 1000000 + y.i) AS ij FROM v x JOIN v y ON x.conv_id = y.conv_id AND x.i < y.i WHERE (x.neg <> y.neg AND len(list_intersect(x.w, y.w)) >= 2 AND len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) >= 0.7) OR (len(list_intersect(x.w, y.w)) >= 1 AND ({_OPPOSED})) GROUP BY 1),
    k AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT k.conv_id, d.conv_id IS NOT NULL AND u.conv_id IS NULL AND p.conv_id IS NULL AS accepted, CASE WHEN d.conv_id IS NULL THEN 'GROUNDING_FAILED' WHEN u.i IS NOT NULL THEN CASE WHEN g.i = u.i THEN 'GROUNDING_FAILED' ELSE 'UNSUPPORTED_CLAIM' END WHEN ij IS NOT NULL THEN 'CONTRADICTION' END AS reason,
      CAST(CASE WHEN d.conv_id IS NOT NULL THEN coalesce(u.i, ij // 1000000) END AS int) AS i, CAST(CASE WHEN d.conv_id IS NOT NULL AND u.i IS NULL THEN ij % 1000000 END AS int) AS j FROM k LEFT JOIN (SELECT DISTINCT conv_id FROM d) d USING (conv_id) LEFT JOIN u USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN p USING (conv_id)""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sentences of a conversation's answers rest on the turns before them and agree with each other."""
    turns = table(spark, sf_dir, "conversations")
    ref = lambda turn: F.struct(turn.cast("string").alias("ref"), F.lit(None).cast("map<string,string>").alias("fields"))
    said = evidence.sentences(turns.where("role = 'assistant'"), ["conv_id", "turn"]).withColumnRenamed("i", "k")
    said = said.withColumn("i", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")) - 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" not", " higher", " lower", "", "")]), F.col("i") % 5 + 1)
    claims = said.select(F.col("conv_id").alias("candidate"), "i", F.concat("sentence", tail).alias("text"), F.array(ref(F.col("turn") - 1)).alias("refs"))
    blocks = turns.select(F.col("conv_id").alias("candidate"), F.col("turn").cast("string").alias("ref"), "text", F.lit(None).cast("map<string,string>").alias("fields"))
    candidates = turns.groupBy(F.col("conv_id").alias("candidate")).agg(F.array(ref(F.min("turn"))).alias("refs"))
    return grounding.grounded(candidates, claims, blocks).withColumnRenamed("candidate", "conv_id")


@query("""
    WITH p AS (SELECT event_id AS plan_id, symbol, us AS plan_us FROM ticks WHERE event_type = 'signup'), t AS (SELECT event_id, symbol, us FROM ticks WHERE event_type = 'view')
    SELECT event_id, CASE WHEN t.us - plan_us <= 21600000000 THEN plan_id END AS plan_id FROM t ASOF LEFT JOIN p ON t.symbol = p.symbol AND t.us >= p.plan_us""")
def plan_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest plan of a symbol that hasn't expired when a tick arrives."""
    ticks = projection(spark, sf_dir, "ticks")
    plans = ticks.where("event_type = 'signup'").select("symbol", F.col("us").alias("plan_us"), F.col("event_id").alias("plan_id"))
    seen = ticks.where("event_type = 'view'").select("event_id", "symbol", "us")
    return asof(seen, plans, "symbol", "us", "plan_us", ["plan_id"], 21_600_000_000, forward=False).select("event_id", F.col("q_plan_id").alias("plan_id"))


@query("""
    WITH used AS (SELECT decision_id, list(DISTINCT part) AS a FROM evals WHERE flag = 'A' GROUP BY 1), rejected AS (SELECT decision_id, list(DISTINCT part) AS r FROM evals WHERE flag = 'R' GROUP BY 1), available AS (SELECT decision_id, list(DISTINCT part) AS v FROM evals WHERE flag <> 'N' OR state = 'F' GROUP BY 1)
    SELECT decision_id, len(list_intersect(coalesce(a, []), coalesce(r, []))) = 0 AS disjoint, len(list_distinct(list_concat(coalesce(a, []), coalesce(r, [])))) = len(v) AS covers FROM available LEFT JOIN used USING (decision_id) LEFT JOIN rejected USING (decision_id)""")
def citation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether used and rejected references are disjoint and together all that were available."""
    rows = projection(spark, sf_dir, "evals")
    sets = rows.groupBy("decision_id").agg(F.collect_set(F.when(F.col("flag") == "A", F.col("part"))).alias("a"), F.collect_set(F.when(F.col("flag") == "R", F.col("part"))).alias("r"), F.collect_set(F.when((F.col("flag") != "N") | (F.col("state") == "F"), F.col("part"))).alias("v"))
    sets = sets.where("size(v) > 0")
    return sets.select("decision_id", (~F.arrays_overlap("a", "r")).alias("disjoint"), (F.size(F.array_union("a", "r")) == F.size("v")).alias("covers"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS double) AS k, TRY_CAST(json_extract_string(props, '$.k') AS double) IS NOT NULL AS k_known, CASE event_type WHEN 'purchase' THEN 1 WHEN 'refund' THEN -1 ELSE 0 END AS direction FROM events")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON with a mask of those known, and an encoded direction."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as double)")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNotNull().alias("k_known"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "refund", -1).otherwise(0).alias("direction"))


@query()
def greedy_near_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass by doc_id keeps: neither copies nor near copies of what it kept before."""
    docs = table(spark, sf_dir, "documents")
    exact = corpus.exact_duplicates(docs)
    first = exact.where("doc_id = kept").select("doc_id")
    pairs = corpus.shingle_pairs(docs)
    return evidence.greedy_kept(first.withColumnRenamed("doc_id", "node"), pairs)


# retrieval readiness, quotas, walk-forward and parameter choice
statement("retrieval_gate", """
    SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'NO_ALIAS' WHEN d.lang NOT IN ('en', 'fr') THEN 'TYPE' WHEN d.n_chars < 100 THEN 'TOO_SHORT' ELSE 'READY' END AS gate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) a ON d.doc_id = a.doc_id""")
statement("active_documents", "SELECT d.source, count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) THEN 1 ELSE 0 END) AS bigint) AS active FROM documents d GROUP BY d.source")
statement("orphan_cleanup", """
    SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_suppkey AND c_acctbal < 0) GROUP BY l_orderkey""")
statement("diverse_selection", """
    SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY in_source, n_chars DESC, doc_id) AS in_lang FROM (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS in_source FROM documents) a WHERE in_source <= 2) b WHERE in_lang <= 25""")
statement("parameter_grid", """
    SELECT strategy, margin, n, expectancy FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY expectancy DESC, margin DESC) AS rn FROM (
      SELECT strategy, g.margin, count(*) AS n, round(avg(pnl - g.margin * volume), 4) AS expectancy FROM trades CROSS JOIN (SELECT 0 AS margin UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 5) g WHERE slippage <= 8e-2 - g.margin * 1e-2 GROUP BY strategy, g.margin HAVING count(*) >= 20) a) b WHERE rn = 1""")
statement("cost_sensitivity", """
    SELECT strategy, c.extra, count(*) AS n, round(avg(pnl - c.extra * volume), 4) AS expectancy, round(avg(CASE WHEN pnl - c.extra * volume > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM trades CROSS JOIN (SELECT 0 AS extra UNION ALL SELECT 1 UNION ALL SELECT 3) c GROUP BY strategy, c.extra""")


@query("""
    SELECT agent, decision_id, CAST(place AS bigint) AS place, kind FROM (SELECT agent, decision_id, row_number() OVER (PARTITION BY agent ORDER BY us DESC, decision_id DESC) AS place, 'same' AS kind FROM runs WHERE us <= 852076800000000) a WHERE place <= 5
    UNION ALL SELECT agent, decision_id, CAST(place AS bigint), kind FROM (SELECT a.agent, r.decision_id, row_number() OVER (PARTITION BY a.agent ORDER BY r.us DESC, r.decision_id DESC) AS place, 'cross' AS kind FROM (SELECT DISTINCT agent FROM runs) a JOIN (SELECT * FROM runs WHERE us <= 852076800000000 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY us DESC, decision_id DESC) <= 3) r ON r.agent <> a.agent AND r.us <= 852076800000000) b WHERE place <= 3""")
def last_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's last five runs and the last three of others.

    At most three runs of each agent can be among the last three of others, and of the six latest of
    those at most three are an agent's own: so every agent meets these six only.
    """
    runs = projection(spark, sf_dir, "runs").where("agent is not null")
    known = similarity.top_k(runs.where("us <= 852076800000000"), ["agent"], [F.desc("us"), F.desc("decision_id")], 5)
    same = known.select("agent", "decision_id", F.col("rank").cast("bigint").alias("place"), F.lit("same").alias("kind"))
    six = known.where("rank <= 3").orderBy(F.desc("us"), F.desc("decision_id")).limit(6).select(F.col("agent").alias("other"), "decision_id", "us")
    met = runs.select("agent").distinct().join(F.broadcast(six), F.col("agent") != F.col("other"))
    cross = similarity.top_k(met, ["agent"], [F.desc("us"), F.desc("decision_id")], 3)
    return same.union(cross.select("agent", "decision_id", F.col("rank").cast("bigint").alias("place"), F.lit("cross").alias("kind")))


statement("macro_vintage", """
    SELECT decision_id, horizon, round(cost, 4) AS v FROM evals WHERE us <= 820454400000000 AND us + lag * 86400000000 >= 820454400000000""")
statement("sentiment_tallies", """
    SELECT source, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS bigint) AS bullish, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bigint) AS bearish, round(1e2 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / nullif(count(quality), 0), 6) AS bullish_pct FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source""")
