"""Forward outcomes of decisions: horizons, as-of quotes, directional arithmetic and excursions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof, extremes
from tidemark.session import stored

HORIZONS_S = (3600, 10800, 21600, 86400)
TOLERANCE_S = 3600


def evaluate_outcomes(decisions: DataFrame, ticks: DataFrame, now_us: int, horizons: tuple[int, ...] = HORIZONS_S, tolerance: int = TOLERANCE_S) -> DataFrame:
    """One row for each decision and horizon; statuses INELIGIBLE, PENDING, DATA_UNAVAILABLE, COMPLETE.

    A decision without an anchor is ineligible. Before target + tolerance it is pending whatever is
    known by then, so rows after ``now_us`` never change an outcome. Excursions cover [anchor, target]
    and are seeded with the entry quote.
    """
    spark = decisions.sparkSession
    spans = spark.createDataFrame([(h,) for h in horizons], "horizon int")
    rows = decisions.crossJoin(F.broadcast(spans)).withColumn("target_us", F.col("anchor_us") + F.col("horizon").cast("bigint") * 1_000_000)
    seen = ticks.where(F.col("us") <= now_us).select("symbol", "us", "bid", "ask").where("bid > 0 and ask >= bid")
    rows = asof(rows, seen, "symbol", "target_us", "us", ["bid", "ask"], tolerance * 1_000_000, forward=True, prefix="future_")
    rows = rows.withColumn(
        "status",
        F.when(F.col("anchor_us").isNull(), "INELIGIBLE").when(F.lit(now_us) < F.col("target_us") + tolerance * 1_000_000, "PENDING").when(F.col("future_us").isNull(), "DATA_UNAVAILABLE").otherwise("COMPLETE"),
    )
    rows = stored(rows)  # the edges of ranges, the blocks between and the result read them
    done = rows.where("status = 'COMPLETE'").select("decision_id", "horizon", "symbol", "anchor_us", (F.col("horizon").cast("bigint") * 1_000_000).alias("length"))
    path = extremes(done, seen, ["decision_id", "horizon"], "symbol", "anchor_us", "length", tuple(h * 1_000_000 for h in horizons), "us", "bid")
    path = path.select("decision_id", "horizon", F.col("most").alias("hi_bid"), F.col("least").alias("lo_bid"))
    rows = rows.join(path, ["decision_id", "horizon"], "left")
    complete = F.col("status") == "COMPLETE"
    buy, sell = (F.col("future_bid") - F.col("ask")) / F.col("point"), (F.col("bid") - F.col("future_ask")) / F.col("point")
    rows = rows.withColumn("buy", F.when(complete, buy)).withColumn("sell", F.when(complete, sell))
    return rows.select(
        "decision_id", "horizon", "action", "status", F.when(complete, F.col("future_us") - F.col("target_us")).alias("lag_us"), F.round("buy", 4).alias("buy_points"), F.round("sell", 4).alias("sell_points"),
        F.when(complete, F.when(F.abs(F.col("buy") - F.col("sell")) < 1e-9, "TIE").when(F.col("buy") > F.col("sell"), "BUY").otherwise("SELL")).alias("best"),
        F.round(F.when(complete & (F.col("action") == "HOLD"), F.greatest(F.lit(0.0), "buy", "sell")), 4).alias("hold_cost"),
        F.round(F.when(complete, F.greatest("hi_bid", "bid") - F.col("ask")), 4).alias("buy_mfe"), F.round(F.when(complete, F.least("lo_bid", "bid") - F.col("ask")), 4).alias("buy_mae"),
    )
