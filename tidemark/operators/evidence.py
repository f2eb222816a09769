"""Evidence from texts: sentences, greedy deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def sentences(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, i, sentence): ends are ``.``, ``!`` or ``?`` before white space, and line ends; trimmed."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+|[\r\n]+")
    out = rows.select(*key, F.posexplode(F.filter(F.transform(parts, F.trim), lambda s: s != "")).alias("i", "sentence"))
    return out


def greedy_kept(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, kept): what one pass in ascending order keeps, if it drops whatever pairs with a kept one.

    ``pairs`` are (a, b), a < b. A node is kept once all smaller partners are dropped, and dropped
    once one is kept; rounds go on until all is decided, as many as the longest chain has links.
    """
    state = cut(nodes.select("node").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    edges = cut(pairs.select("a", "b").distinct())
    while True:
        before = edges.join(state.select(F.col("node").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("hit"), F.bool_or(F.col("ka").isNull()).alias("open"))
        judged = state.join(before, state.node == before.b, "left")
        kept = F.coalesce("kept", F.when(F.col("b").isNull(), True).when(F.col("hit"), False).when(~F.col("open"), True))
        state = cut(judged.select("node", kept.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state
