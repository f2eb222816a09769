"""Exact quantiles of few keys over many values, by refining histograms.

A sort of all values of a key would put them into one task. Here a value of a wanted rank is closed in on:
each pass counts how many values fall in each of some cells between the least and the greatest that it
can be, finds the cell that holds the rank, and goes on with the least and greatest value seen there,
until both are the same. Only counts travel, combined before the shuffle; repeated values never meet.
Every pass parts at least the least from the greatest, and usually all but some thousandths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

CELLS = 4096


def nearest(p: float) -> tuple[str, float]:
    """The value of rank ceil(p n), 1 at least."""
    return "nearest", p


def linear(p: float) -> tuple[str, float]:
    """Between the values at the places around p (n - 1), from 0."""
    return "linear", p


#: The upper of two middle values.
UPPER = ("upper", 0.5)


def _places(kind: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """The places from 0 of the two values, and how far to go from the first to the second."""
    if kind == "linear":
        at = F.lit(p) * (n - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)
    at = F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)) if kind == "nearest" else F.floor(n / 2)
    return at, at, F.lit(0.0)


def _on(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"{n}_of"]) for n in names], F.lit(True))


def exact(rows: DataFrame, key: list[str], value: str, wanted: dict[str, tuple[str, float]], cells: int = CELLS) -> DataFrame:
    """A row for each key with a column for each wanted quantile; nulls and NaN are no values.

    Keys without a value have none of the quantiles.
    """
    values = rows.select(*key, F.col(value).cast("double").alias("v_")).where(F.col("v_").isNotNull() & ~F.isnan("v_"))
    sizes = cut(values.groupBy(*key).agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_")))
    places = {name: _places(*how, F.col("n_")) for name, how in wanted.items()}
    ranks = F.array_distinct(F.array(*[x.cast("bigint") for a, b, _ in places.values() for x in (a, b)]))
    state = cut(sizes.select(*key, F.explode(ranks).alias("k_"), "lo_", "hi_", F.lit(0).cast("bigint").alias("below_")))
    while state.where("lo_ < hi_").limit(1).count():
        ranges = state.where("lo_ < hi_").select(*[F.col(c).alias(f"{c}_of") for c in key], F.col("lo_").alias("from_"), F.col("hi_").alias("to_"), F.col("below_").alias("below_")).distinct()
        inside = values.join(ranges, _on(values, ranges, key) & F.col("v_").between(F.col("from_"), F.col("to_")))
        v, a, b = F.col("v_"), F.col("from_"), F.col("to_")
        great = F.greatest(F.abs(a), F.abs(b)) > 1e300  # a difference of such may pass the greatest number, half of a tiny one may be zero
        share = F.when(great, (v / 2 - a / 2) / (b / 2 - a / 2)).otherwise((v - a) / (b - a))
        own = [f"{c}_of" for c in key]
        counted = inside.groupBy(*own, "from_", "to_", "below_", F.least(F.floor(share * cells), F.lit(cells - 1)).alias("cell_")).agg(F.count("*").alias("m_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
        earlier = Window.partitionBy(*own, "from_", "to_").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before_", F.col("below_") + F.coalesce(F.sum("m_").over(earlier), F.lit(0)))
        here = _on(state, counted, key) & (state.lo_ == counted.from_) & (state.hi_ == counted.to_) & (state.k_ >= counted.before_) & (state.k_ < counted.before_ + counted.m_)
        closer = state.where("lo_ < hi_").join(counted, here).select(*[state[c] for c in key], "k_", F.col("least_").alias("lo_"), F.col("most_").alias("hi_"), F.col("before_").alias("below_"))
        state = cut(state.where("lo_ >= hi_").unionByName(closer))
    found = state.groupBy(*[F.col(c).alias(f"{c}_of") for c in key]).agg(F.map_from_entries(F.collect_list(F.struct("k_", "lo_"))).alias("at_"))  # two entries a quantile at most
    out = sizes.join(found, _on(sizes, found, key))
    value_at = lambda place: F.element_at("at_", place.cast("bigint"))
    return out.select(*[sizes[c] for c in key], *[F.when(share == 0, value_at(a)).otherwise(value_at(a) + (value_at(b) - value_at(a)) * share).alias(name) for name, (a, b, share) in places.items()])
