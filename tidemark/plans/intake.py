"""Time, symbols, vendor ranges, imports and splits. Each oracle states its query in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock, text
from tidemark.operators import gates as rules
from tidemark.operators import ingest, intake, order, similarity
from tidemark.plans.gates import _REASONS, AS_OF, observations
from tidemark.plans.registry import projection, query
from tidemark.session import Scratch, cut, table


@query("""
    WITH t AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS date) AS varchar) AS day, CASE o_orderkey % 5 WHEN 0 THEN 'T12:30:00Z' WHEN 1 THEN ' 12:30:00.250+00:00' WHEN 2 THEN 'T12:30:00' WHEN 3 THEN 'T12:30:00+02:00' ELSE 'T25:30:00Z' END AS rest FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(CAST(day AS timestamp)) + 45000000000 WHEN 1 THEN epoch_us(CAST(day AS timestamp)) + 45000250000 END AS us FROM t""")
def utc_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of text that names UTC; naive text, other offsets and bad times are null."""
    k = F.col("o_orderkey") % 5
    rest = F.when(k == 0, "T12:30:00Z").when(k == 1, " 12:30:00.250+00:00").when(k == 2, "T12:30:00").when(k == 3, "T12:30:00+02:00").otherwise("T25:30:00Z")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderdate").cast("date").cast("string"), rest).alias("t"))
    return rows.select("o_orderkey", F.unix_micros(clock.utc_instant(F.col("t"))).alias("us"))


_TIMES = """h AS (SELECT o_orderkey AS ticket, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE @us(o_orderdate) // 1000 END AS time_msc, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE @us(o_orderdate) // 1000000 + 60 END AS time,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE @us(o_orderdate) // 1000000 + 120 END AS time_setup, CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE @us(o_orderdate) // 1000000 + 180 END AS time_done FROM orders)"""


@query(f"WITH {_TIMES}, u AS (SELECT ticket, coalesce(nullif(time_msc, 0) * 1000, nullif(time, 0) * 1000000, nullif(time_setup, 0) * 1000000, nullif(time_done, 0) * 1000000) - 7200000000 AS us FROM h) SELECT ticket, us FROM u WHERE us BETWEEN 788918400000000 AND {AS_OF}")
def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker history of a range: the first of four time fields, less the broker's offset."""
    k, us = F.col("o_orderkey"), F.unix_micros("o_orderdate")
    second = F.floor(us / 1_000_000)
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select(
        k.alias("ticket"), F.when(k % 4 == 0, 0).when(k % 4 == 1, None).otherwise(F.floor(us / 1000)).alias("time_msc"), F.when(k % 3 == 0, 0).otherwise(second + 60).alias("time"),
        F.when(k % 2 == 0, None).otherwise(second + 120).alias("time_setup"), F.when(k % 12 == 0, 0).otherwise(second + 180).alias("time_done"),
    )
    return intake.history(rows, 7200, start_us=788_918_400_000_000, end_us=AS_OF).select("ticket", "us")


@query("SELECT o_orderkey, CAST(o_orderdate AS date) + CAST(CASE dayofweek(CAST(o_orderdate AS date)) WHEN 0 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS int) AS day FROM orders")
def next_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.next_weekday(F.col("o_orderdate").cast("date")).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 1706486400000000 + 86400000000 >= 1706500000000000 ELSE us >= 1704931200000000 AND us < 1706486400000000 + 86400000000 END AS inside FROM ticks")
def news_window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether news is inside a half-open window; undated news only as the window reaches now."""
    us = F.when(F.col("event_id") % 13 != 0, F.col("us"))
    return projection(spark, sf_dir, "ticks").select("event_id", clock.in_window(us, 1_704_931_200_000_000, 1_706_486_400_000_000, 1_706_500_000_000_000).alias("inside"))


_SYMBOLS = ["XAUUSD+", " btc-usdt ", "EURUSD", "eurxxx", "us30", "GC=F", "DOGEUSD++", "ETH", "AAPL", "SOLUSDC", "  ", "USDUSD"]
_CANON = ["GC=F", "BTC-USD", "EURUSD=X", "EURXXX", "^DJI", "GC=F", "DOGE-USD", "ETH", "AAPL", "SOL-USD", "  ", "USDUSD=X"]


@query(f"SELECT p_partkey, {_CANON!r}[p_partkey % 12 + 1] AS canonical FROM part")
def symbol_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's symbol as a data vendor names it; the oracle has the expected names."""
    raw = F.element_at(F.array(*[F.lit(s) for s in _SYMBOLS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_symbol(raw).alias("canonical"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN NULL WHEN p_partkey % 6 = 2 THEN 'BRK.B' WHEN p_partkey % 6 = 3 THEN '^GSPC' WHEN p_partkey % 6 = 4 THEN NULL END AS safe FROM part")
def path_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are safe as one part of a path."""
    raw = F.element_at(F.array(*[F.lit(s) for s in ("../../etc", "...", "BRK.B", "^GSPC", "A" * 33, "a b")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.path_component(raw).alias("safe"))


_RATED = ["no view at all", "Rating: **Buy**\nwe would sell", "We hold it.\nrating - underweight", "a Buyer may be overweight", "Rating: strong\nSELL it", ""]


@query("SELECT conv_id, turn, [NULL, 'Buy', 'Underweight', 'Overweight', 'Sell', NULL][conv_id % 6 + 1] AS rating, [NULL, 'BUY', 'SELL', 'BUY', 'SELL', NULL][conv_id % 6 + 1] AS action FROM conversations")
def rating_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings out of the end of each turn's text, and the action of each; the oracle has the expected ones."""
    said = F.concat_ws("\n", F.regexp_replace("text", "(?i)buy|sell|hold|weight|rating", ""), F.element_at(F.array(*[F.lit(s) for s in _RATED]), (F.col("conv_id") % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.rating(said).alias("rating"))
    return rows.select("conv_id", "turn", "rating", text.rating_action(F.col("rating")).alias("action"))


@query("""
    WITH a AS (SELECT run_id, unnest(json_keys(metrics_json, '$.agents')) AS agent, metrics_json AS j FROM metrics WHERE json_valid(metrics_json) AND json_type(metrics_json, '$.agents') = 'OBJECT'),
    v AS (SELECT agent, trim(json_extract_string(j, '$.agents.' || agent || '.model')) AS model, greatest(0, CAST(json_extract_string(j, '$.agents.' || agent || '.calls') AS bigint)) AS calls, CAST(json_extract_string(j, '$.agents.' || agent || '.tokens_in') AS bigint) AS tin, CAST(json_extract_string(j, '$.agents.' || agent || '.tokens_out') AS bigint) AS tout, CAST(json_extract_string(j, '$.agents.' || agent || '.elapsed_seconds') AS double) AS s FROM a)
    SELECT agent, count(*) AS runs, string_agg(DISTINCT model, ',' ORDER BY model) AS models, CAST(sum(calls) AS bigint) AS calls, CAST(sum(tin) AS bigint) AS tokens_in, CAST(sum(tout) AS bigint) AS tokens_out, round(avg(s), 6) AS mean_s, round(quantile_cont(s, 0.5), 6) AS median_s, round(quantile_cont(s, 0.95), 6) AS p95_s, max(s) AS most_s FROM v GROUP BY agent""")
def agent_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry by agent out of the JSON map of each run."""
    return intake.agent_metrics(projection(spark, sf_dir, "metrics"))


@query("""
    SELECT symbol, CAST(make_timestamp(day_us) AS date) AS date, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close FROM bars WHERE day_us >= 1704844800000000 AND day_us < 1705363200000000 + 86400000000""")
def ohlcv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of two days inclusive, to the cent."""
    bars = projection(spark, sf_dir, "bars").select("symbol", F.timestamp_micros("day_us").cast("date").alias("date"), "open", "high", "low", "close")
    return intake.bars_between(bars, "2024-01-10", "2024-01-16")


_PERIODS = [f"{y}-{m}" for y in (1995, 1996, 1997) for m in ("03-31", "06-30", "09-30", "12-31")]


@query("""
    WITH q AS (SELECT o_orderpriority, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS date)) AS period, o_totalprice FROM orders)
    SELECT o_orderpriority, CAST(period AS varchar) AS period, round(sum(o_totalprice), 2) AS value FROM q WHERE period BETWEEN DATE '1995-03-31' AND DATE '1996-08-15' GROUP BY 1, 2""")
def statements_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with a column for each quarter, as rows of the periods ended by a day."""
    quarter = F.last_day(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 2)).cast("string")
    wide = table(spark, sf_dir, "orders").withColumn("period", quarter).groupBy("o_orderpriority").pivot("period", _PERIODS)
    wide = wide.agg(F.round(F.sum("o_totalprice"), 2)).withColumn("TTM", F.lit(0.0))
    return intake.columns_asof(wide, ["o_orderpriority"], "1996-08-15").where("value is not null")


@query("SELECT o_custkey, count(*) AS reports, max(CAST(CAST(o_orderdate AS date) AS varchar)) AS last_end FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def fundamentals_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each company's array of reports those ended by a day."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderdate").cast("date").cast("string").alias("fiscal_end"), "o_orderkey")).alias("reports"))
    kept = intake.reports_asof(rows, "reports", "1995-12-31").where("size(reports) > 0")
    return kept.select("o_custkey", F.size("reports").cast("bigint").alias("reports"), F.array_max(F.transform("reports", lambda r: r["fiscal_end"])).alias("last_end"))


@query("SELECT l_orderkey AS intent_id, l_linenumber, round(l_extendedprice, 2) AS fill_price, o_orderpriority AS kind FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_linestatus = 'F' AND o_orderstatus <> 'P' AND l_extendedprice > 0")
def filled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled results with the intents they came from."""
    results = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'F' and l_extendedprice > 0").select(F.col("l_orderkey").alias("intent_id"), "l_linenumber", F.round("l_extendedprice", 2).alias("fill_price"))
    intents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("intent_id"), F.col("o_orderpriority").alias("kind"))
    return results.join(intents, "intent_id")


@query("SELECT CASE WHEN o_totalprice IS NULL THEN 'NO_PRICE' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_custkey % 13 = 0 THEN 'NO_ACCOUNT' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sinks, accepted ones and those with a reason."""
    reason = rules.chain([("NO_PRICE", F.col("o_totalprice").isNull()), ("PENDING", F.col("o_orderstatus") == "P"), ("NO_ACCOUNT", F.col("o_custkey") % 13 == 0)])
    good, bad = intake.quarantined(table(spark, sf_dir, "orders"), reason)
    return good.select(F.lit(None).cast("string").alias("reason")).union(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SIDES = "s AS (SELECT o_orderkey % 3 AS source_id, o_orderkey AS decision_id, CASE WHEN o_orderkey % 17 = 0 THEN 'new' ELSE 'old' END AS fingerprint FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0), c AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE o_orderkey % 3 END AS source_id, o_orderkey AS decision_id, 'old' AS fingerprint, CASE WHEN o_orderkey % 19 = 0 THEN 'GONE' ELSE 'CURRENT' END AS state FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"""WITH {_SIDES}, j AS (SELECT s.*, c.fingerprint AS known, c.state, c.source_id AS other FROM s LEFT JOIN c ON c.decision_id = s.decision_id)
    SELECT source_id, decision_id, CASE WHEN known IS NULL THEN 'INDEXED' WHEN known <> fingerprint THEN 'QUARANTINED' WHEN other = source_id AND state = 'CURRENT' THEN 'UNCHANGED' ELSE 'ALIAS' END AS outcome FROM j
    UNION ALL SELECT source_id, decision_id, 'REMOVED' FROM c WHERE state = 'CURRENT' AND source_id IN (0, 1) AND NOT EXISTS (SELECT 1 FROM s WHERE s.decision_id = c.decision_id AND s.source_id = c.source_id)""")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What importing two sources into a catalog does with each row."""
    k, rows = F.col("o_orderkey"), table(spark, sf_dir, "orders").select("o_orderkey")
    source = rows.where("o_orderkey % 3 < 2 and o_orderkey % 7 <> 0").select((k % 3).alias("source_id"), k.alias("decision_id"), F.when(k % 17 == 0, "new").otherwise("old").alias("fingerprint"))
    catalog = rows.where("o_orderkey % 5 <> 0").select(F.when(k % 13 == 0, 2).otherwise(k % 3).alias("source_id"), k.alias("decision_id"), F.lit("old").alias("fingerprint"), F.when(k % 19 == 0, "GONE").otherwise("CURRENT").alias("state"))
    return intake.merged_import(source, catalog)


@query("SELECT 'observation-' || experience_id AS finding_id, experience_id, symbol, tier FROM experiences WHERE coalesce(tombstoned, 1) = 0 AND tier IN ('A', 'B') AND experience_id % 4 <> 0")
def bridged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of live, trusted experiences that aren't known yet."""
    rows = projection(spark, sf_dir, "experiences")
    return intake.findings(rows, rows.where("experience_id % 4 = 0").select(F.concat(F.lit("observation-"), F.col("experience_id").cast("string")).alias("finding_id")))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND (doc_id % 3 <> 0 OR doc_id % 12 = 0)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a cached vector of the current spec and text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    cached = docs.where("doc_id % 3 = 0").select("doc_id", "sha256", F.when(F.col("doc_id") % 12 == 0, "v1").otherwise("v2").alias("spec"))
    return intake.missing_vectors(docs, cached, "v2").select("doc_id")


@query("""
    WITH c AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 25), i AS (SELECT DISTINCT p_brand, p_size % 4 AS component, p_type FROM part WHERE p_size > 25)
    SELECT i.p_brand AS strategy, i.component, CASE count(c.p_type) WHEN 0 THEN 'NO_DIRECT_MATCH' WHEN count(*) THEN 'MATCHED' ELSE 'PARTIALLY_MATCHED' END AS status, count(c.p_type) AS matched FROM i LEFT JOIN c ON c.p_brand = i.p_brand AND c.p_type = i.p_type GROUP BY 1, 2""")
def strategy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed rules of strategies against those that components implement."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("strategy"), (F.col("p_size") % 4).alias("component"), F.col("p_type").alias("signature"), "p_size")
    return intake.rule_mapping(rows.where("p_size <= 25"), rows.where("p_size > 25").select("strategy", "component", "signature"))


@query(f"""WITH {_REASONS}, g AS (SELECT * FROM l WHERE len(reasons) = 0), f AS (SELECT run_id, min(analysis_us) AS a FROM g GROUP BY 1), o AS (SELECT run_id, row_number() OVER (ORDER BY a, run_id) AS rn, count(*) OVER () AS n FROM f),
    b AS (SELECT *, n * 70 // 100 + CASE WHEN n - n * 70 // 100 - 2 * (n * 15 // 100) > (CASE WHEN n * 70 % 100 >= n * 15 % 100 THEN 0 ELSE 2 END) THEN 1 ELSE 0 END AS t, n - n * 70 // 100 - 2 * (n * 15 // 100) AS spare FROM o),
    s AS (SELECT *, n * 15 // 100 + CASE WHEN spare - (t - n * 70 // 100) >= 1 THEN 1 ELSE 0 END AS v FROM b)
    SELECT run_id, CASE WHEN rn <= t THEN 'train' WHEN rn <= t + v THEN 'validation' ELSE 'test' END AS split FROM s""")
def dataset_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of eligible observations in time order, 70, 15 and 15 by largest remainder."""
    good = rules.dataset_reasons(observations(spark, sf_dir), "ANALYSIS_SNAPSHOT", 3600, AS_OF).where("size(reasons) = 0")
    return order.chronological_group_split(good, ["run_id"], "analysis_us").select("run_id", "split")


@query(f"""WITH {_REASONS} SELECT 'ex_' || sha256(CAST(decision_id AS varchar) || chr(31) || 'ANALYSIS_SNAPSHOT' || chr(31) || '3600') AS example_id, '{{"decision_id":' || decision_id || ',"run_id":' || run_id || '}}' AS decision FROM l WHERE len(reasons) = 0""")
def canonical_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples of eligible observations, named by their identity."""
    rows = rules.dataset_reasons(observations(spark, sf_dir), "ANALYSIS_SNAPSHOT", 3600, AS_OF)
    done = intake.built_dataset(rows, ["decision_id", "eval_basis", "eval_horizon_s"], ["run_id"], "analysis_us")
    return intake.canonical(done, ["decision_id", "eval_basis", "eval_horizon_s"], {"decision": ["decision_id", "run_id"]})


@query("""
    WITH d AS (SELECT DISTINCT day_us FROM bars), r AS (SELECT day_us, row_number() OVER (ORDER BY day_us) - 1 AS i, count(*) OVER () AS n FROM d)
    SELECT day_us FROM r WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS bigint) FROM (SELECT unnest(range(5)) AS k), (SELECT max(n) AS n FROM r))""")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five days spread evenly, halves rounded to even."""
    return order.evenly_spaced(projection(spark, sf_dir, "bars").select("day_us").distinct(), ["day_us"], 5).select("day_us")


@query("""
    WITH d AS (SELECT DISTINCT us - us % 3600000000 AS us FROM ticks), r AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM d),
    w AS (SELECT k AS window_no, CAST(floor(k * n / 7.0) AS bigint) AS a, CAST(floor((k + 1) * n / 7.0) AS bigint) AS b FROM (SELECT unnest(range(7)) AS k), (SELECT max(n) AS n FROM r))
    SELECT window_no, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM w JOIN r ON i >= a AND i < b GROUP BY 1""")
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven windows of hours by place, which need not divide their number."""
    hours = projection(spark, sf_dir, "ticks").select((F.col("us") - F.col("us") % 3_600_000_000).alias("us")).distinct()
    placed = order.positioned(hours, ["us"])
    n = F.lit(placed.count())
    rows = placed.withColumn("window_no", order.slice_of(F.col("position"), n, 7).cast("bigint"))
    return rows.groupBy("window_no").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("""
    WITH o AS (SELECT strategy, pnl, row_number() OVER (PARTITION BY strategy ORDER BY us, trade_id, pnl, volume) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM trades),
    f AS (SELECT strategy, pnl, (SELECT max(k) FROM (SELECT unnest(range(5)) AS k) s WHERE floor(k * n / 5.0) <= i) AS fold FROM o)
    SELECT strategy, fold, count(*) AS n, round(avg(pnl), 4) AS expectancy FROM f GROUP BY strategy, fold""")
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of five folds of each strategy's trades by place."""
    trades = order.positioned(projection(spark, sf_dir, "trades").select("strategy", "us", "trade_id", "pnl", "volume"), ["strategy", "us", "trade_id", "pnl", "volume"])
    bounds = trades.groupBy("strategy").agg(F.min("position").alias("lo"), F.count("*").alias("n"))
    rows = trades.join(bounds, "strategy").withColumn("fold", order.slice_of(F.col("position") - F.col("lo"), F.col("n"), 5).cast("bigint"))
    return rows.groupBy("strategy", "fold").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 4).alias("expectancy"))


@query("""
    WITH t AS (SELECT DISTINCT us - us % 60000000 AS us FROM ticks), r AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM t), c AS (SELECT (SELECT us FROM r WHERE i = n // 2) AS a, (SELECT us FROM r WHERE i = 3 * n // 4) AS b),
    p AS (SELECT us, CASE WHEN i < n // 2 AND us < a - 600000000 THEN 'development' WHEN i >= n // 2 AND i < 3 * n // 4 AND us >= a + 600000000 AND us < b - 600000000 THEN 'validation' WHEN i >= 3 * n // 4 AND us >= b + 600000000 THEN 'unseen' END AS part FROM r, c)
    SELECT part, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM p WHERE part IS NOT NULL GROUP BY part""")
def replay_guarded_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of minutes by place, ten minutes away from the borders."""
    minutes = projection(spark, sf_dir, "ticks").select((F.col("us") - F.col("us") % 60_000_000).alias("us")).distinct()
    return order.guarded_split(minutes, "us", 600_000_000).groupBy("part").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("""
    WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS i FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY i, source, doc_id) AS j FROM a)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY j, lang, source, doc_id) AS bigint) AS place FROM b""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by turns of languages, and of sources inside each; places by ranges, not in one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = similarity.top_k(rows, ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 1 << 62).withColumnRenamed("rank", "i")
    rows = similarity.top_k(rows, ["lang"], [F.col("i"), F.col("source"), F.col("doc_id")], 1 << 62).withColumnRenamed("rank", "j")
    return order.positioned(rows.select("doc_id", "lang", "source", "j"), ["j", "lang", "source", "doc_id"]).select("doc_id", (F.col("position") + 1).alias("place"))


_QUOTES = [
    ("ENTRY", "LONG when momentum > 1.5 points after breakout"), ("EXIT", "EXIT: SHORT when spread_points <= 0.35 pips after a re-test of range."), ("ENTRY", "EXIT: LONG when volatility >= 0 fraction after open"),
    ("EXPECTED_MOVE", "EXPECTED_MOVE: SHORT target -12.25 points within 90 seconds after entry"), ("HORIZON", "HORIZON: hold no longer than 30 seconds after entry"), ("HORIZON", "hold for a while"),
]
_PARSED = "[('LONG', 'momentum', '>', 1.5, 'points', NULL), ('SHORT', 'spread_points', '<=', 0.35, 'pips', NULL), NULL, ('SHORT', NULL, '>=', -12.25, 'points', 90), ('BOTH', NULL, '<=', 30, 'seconds', 30), NULL]"


@query(f"WITH r AS (SELECT p_partkey, {_PARSED}[p_partkey % 6 + 1] AS r FROM part) SELECT p_partkey, r[1] AS direction, r[2] AS feature, r[3] AS operator, CAST(r[4] AS double) AS value, r[5] AS unit, CAST(r[6] AS bigint) AS seconds, CASE WHEN r IS NOT NULL THEN r[2] IS NULL OR r[2] = 'momentum' END AS applies FROM r")
def rule_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that sentences state at a stage; the oracle has the expected parts."""
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    stage, quote = (F.element_at(F.array(*[F.lit(q[i]) for q in _QUOTES]), at) for i in (0, 1))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.rule(quote, stage).alias("r"))
    return rows.select("p_partkey", "r.direction", "r.feature", "r.operator", F.col("r.value").cast("double").alias("value"), "r.unit", "r.seconds", F.when(F.col("r").isNotNull(), text.known_unit(F.col("r"))).alias("applies"))


@query("SELECT trim(lower(nfc_normalize(text))) = '' AS blank, count(*) AS n FROM conversations GROUP BY 1")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a Unicode normal form, case-folded: how many are blank."""
    rows = table(spark, sf_dir, "conversations").select(text.unicode_form("NFC", True)("text").alias("t"))
    return rows.groupBy((F.trim("t") == "").alias("blank")).agg(F.count("*").alias("n"))


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS q, b.vec_id AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT d AS doc_id, count(*) AS "references", CAST(min(r) AS int) AS best_rank, string_agg(q || ':' || r, ',' ORDER BY q) AS refs FROM d WHERE r <= 10 GROUP BY d""")
def discovery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a bank of queries found, with the query and rank of each hit."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return intake.discovery(similarity.nearest(rows, rows.where("id % 50 = 0"), 10))


_NOW = "CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END"


@query(f"""
    WITH a AS (SELECT doc_id AS path, sha256(text) AS h, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS path, sha256({_NOW}) AS h FROM documents WHERE doc_id % 4 <> 0),
    f AS (SELECT h, min(CAST(path AS varchar)) AS first FROM b WHERE h NOT IN (SELECT h FROM a) GROUP BY h),
    s AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'REMOVED' WHEN b.h = a.h THEN 'UNCHANGED' WHEN f.first = CAST(b.path AS varchar) THEN 'INDEXED' ELSE 'DUPLICATE' END AS state FROM a FULL JOIN b ON a.path = b.path LEFT JOIN f ON f.h = b.h)
    SELECT state, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'documents', count(DISTINCT h) FROM b UNION ALL SELECT 'again ' || CASE WHEN state = 'REMOVED' THEN 'REMOVED' ELSE 'UNCHANGED' END, count(*) FROM s WHERE state <> 'REMOVED' GROUP BY 1""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a second run over documents some of which are new, changed or gone, and of a third that finds the same."""
    docs = table(spark, sf_dir, "documents")
    feed = lambda rows, body: rows.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.expr(body).cast("binary"), 256).alias("sha"), F.expr(body).alias("text"))
    second = feed(docs.where("doc_id % 4 <> 0"), _NOW)
    with Scratch(spark) as scratch:
        ingest.ingest(feed(docs.where("doc_id % 3 <> 0"), "text"), scratch.top)
        counts = ingest.ingest(second, scratch.top).groupBy("state").agg(F.count("*").alias("n"))
        size = ingest.opened(spark, scratch.top).documents.agg(F.lit("documents").alias("state"), F.count("*").alias("n"))
        again = ingest.ingest(second, scratch.top).groupBy(F.concat(F.lit("again "), "state").alias("state")).agg(F.count("*").alias("n"))
        return cut(counts.unionByName(size).unionByName(again))
