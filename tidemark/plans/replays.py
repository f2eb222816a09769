"""Indicators by series, replays, walk-forward results and parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators, replay
from tidemark.plans.registry import projection, query
from tidemark.session import table

GAP = 7_200_000_000
POLICIES = [replay.Policy("base"), replay.Policy("tight", stop=10.0, target=15.0), replay.Policy("patient", max_ticks=120, trail=15.0)]

_EWM = """r AS (SELECT symbol, day_us, close, row_number() OVER (PARTITION BY symbol ORDER BY day_us) AS i FROM bars),
    e AS (SELECT a.symbol, a.day_us, a.i, sum(b.close * pow(9e0 / 11, a.i - b.i)) / sum(pow(9e0 / 11, a.i - b.i)) AS e10, sum(b.close * pow(11e0 / 13, a.i - b.i)) / sum(pow(11e0 / 13, a.i - b.i)) - sum(b.close * pow(25e0 / 27, a.i - b.i)) / sum(pow(25e0 / 27, a.i - b.i)) AS macd
      FROM r a JOIN r b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2, 3),
    s AS (SELECT a.symbol, a.day_us, sum(b.macd * pow(8e-1, a.i - b.i)) / sum(pow(8e-1, a.i - b.i)) AS signal FROM e a JOIN e b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2),
    m AS (SELECT symbol, day_us, i, close - lag(close) OVER (PARTITION BY symbol ORDER BY day_us) AS d FROM r),
    w AS (SELECT a.symbol, a.day_us, sum(greatest(b.d, 0e0) * pow(13e0 / 14, a.i - b.i)) AS up, sum(greatest(-b.d, 0e0) * pow(13e0 / 14, a.i - b.i)) AS down FROM m a JOIN m b ON a.symbol = b.symbol AND b.i <= a.i AND b.d IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_EWM} SELECT e.symbol, e.day_us, round(e10, 6) AS ema_10, round(macd, 6) AS macd, round(signal, 6) AS macd_signal, round(macd - signal, 6) AS macd_hist, round(1e2 * up / nullif(up + down, 0), 4) AS rsi_14 FROM e JOIN s USING (symbol, day_us) LEFT JOIN w USING (symbol, day_us)")
def ema_macd_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.exponential(projection(spark, sf_dir, "bars"))


@query(f"""WITH {_EWM}, sb AS (SELECT symbol, day_us, close, round(avg(close) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS sma_20, row_number() OVER (PARTITION BY symbol ORDER BY day_us DESC) AS k FROM bars WHERE day_us <= 1706140800000000)
    SELECT sb.symbol, sb.day_us, close, sma_20 FROM sb WHERE k = 1""")
def market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar known by a date, with its average: rows after the date change nothing."""
    from pyspark.sql import Window

    bars = projection(spark, sf_dir, "bars").where("day_us <= 1706140800000000")
    w = Window.partitionBy("symbol").orderBy("day_us")
    rows = bars.withColumn("sma_20", F.round(F.avg("close").over(w.rowsBetween(-19, 0)), 6)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day_us"))))
    return rows.where("k = 1").select("symbol", "day_us", "close", "sma_20")


@query()
def candidate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(projection(spark, sf_dir, "ticks"), POLICIES, GAP)


@query()
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = replay.replay(projection(spark, sf_dir, "ticks"), POLICIES, GAP)
    return trades.groupBy("candidate", "exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg("mfe"), 4).alias("mean_mfe"))


@query("""
    WITH c AS (SELECT symbol % 2 AS side, us // 3600000000 AS hour, sum(mid - 100) AS s, count(*) AS n FROM ticks GROUP BY 1, 2), k AS (SELECT side, count(*) AS clusters, sum(s) / sum(n) AS mean FROM c GROUP BY 1),
    p AS (SELECT side, s, n, row_number() OVER (PARTITION BY side ORDER BY hour) - 1 AS slot, count(*) OVER (PARTITION BY side) AS size FROM c),
    d AS (SELECT side, draw, CAST('0x' || md5('14:' || draw || ':' || slot)[1:15] AS bigint) % size AS slot FROM p CROSS JOIN (SELECT unnest(range(4000)) AS draw) r),
    m AS (SELECT d.side, draw, sum(s) / sum(n) AS m FROM d JOIN p ON p.side = d.side AND p.slot = d.slot GROUP BY 1, 2)
    SELECT k.side, clusters, 'ESTIMATED' AS status, round(mean, 6) AS mean, round(quantile_cont(m, 0.0125), 6) AS lower, round(quantile_cont(m, 0.9875), 6) AS upper FROM k JOIN m ON m.side = k.side GROUP BY k.side, clusters, mean""")
def hour_cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval of the mean move, resampling whole hours, for two trials."""
    rows = projection(spark, sf_dir, "ticks").select((F.col("symbol") % 2).alias("side"), F.floor(F.col("us") / 3_600_000_000).alias("hour"), (F.col("mid") - 100).alias("points"))
    out = replay.cluster_bootstrap(rows, "hour", "points", "side", trials=2)
    return out.select("side", "clusters", "status", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])
