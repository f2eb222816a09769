"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge.

    Labels spread to neighbours and then jump to the label of their label, so a chain of n nodes
    takes about log n rounds; each round is checkpointed. Minima are combined before they are
    shuffled, and joins are plain inner joins, which Spark splits where a node is hot.
    Nulls and loops are ignored; an empty table gives an empty result.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node <> other")
    both = cut(both.union(both.select("other", "node")).distinct())
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        spread = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("label"))
        jump = spread.join(spread.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = cut(jump.select("node", "root", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = after.where("label <> root").limit(1).count()
        labels = after.select("node", F.col("label").alias("root"))
        if not changed:
            return labels
