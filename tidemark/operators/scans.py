"""Scans along the order of each key that are carried over buckets.

``PARTITION BY key`` over a whole history puts a key's rows into one task. Here rows are dealt by (key,
bucket), a bucket being a span of the order (a day of ticks, some thousand arrivals), and a scan runs in two
passes: each bucket is reduced to what later ones need of it (its last rows, its sums, its peaks), those
few rows are scanned along the key, and what comes out is carried into the bucket. Reductions are
associative, so any bucketing gives the same result; a hot key runs in as many tasks as it has buckets.

Buckets must rise with the order. Null keys are a key of their own, as in windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The column of the bucket, and of whether a row only stands before the bucket.
BUCKET, CONTEXT = "bucket_", "context_"


def span(at: str, width: int) -> Column:
    """Buckets of ``width`` units of a number that the order rises with."""
    return F.floor(F.col(at) / F.lit(width))


def line(key: list[str], order: list[str]) -> Window:
    """The window of a bucket's rows in their order."""
    return Window.partitionBy(*key, BUCKET).orderBy(*order)


def with_context(rows: DataFrame, key: list[str], order: list[str], bucket: Column, tail: int = 1) -> DataFrame:
    """The rows with their bucket, and in each bucket the ``tail`` rows of the key before it, marked as context.

    Windows over ``line`` that look back ``tail`` rows at most see what they would see in the whole key.
    """
    dealt = rows.withColumn(BUCKET, bucket)
    row = F.struct(*rows.columns)
    if tail == 1:
        last = dealt.groupBy(*key, BUCKET).agg(F.array(F.max_by(row, F.struct(*order))).alias("tail"))
    else:
        back = Window.partitionBy(*key, BUCKET).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        few = dealt.withColumn("back_", F.row_number().over(back)).where(F.col("back_") <= tail)
        last = few.groupBy(*key, BUCKET).agg(F.sort_array(F.collect_list(F.struct((-F.col("back_")).alias("at"), row.alias("row")))).getField("row").alias("tail"))
    # a bucket has a row at least, so the last ``tail`` rows are in the last ``tail`` buckets
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy(*key).orderBy(BUCKET).rowsBetween(-tail, -1)))
    last = last.withColumn("before_", before)
    before = F.when(F.size("before_") > tail, F.slice("before_", -tail, tail)).otherwise(F.col("before_"))
    context = last.select(BUCKET, F.explode(before).alias("row")).select("row.*", BUCKET, F.lit(True).alias(CONTEXT))
    return dealt.withColumn(CONTEXT, F.lit(False)).unionByName(context)


def without_context(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(CONTEXT)).drop(CONTEXT)


def previous(rows: DataFrame, key: list[str], order: list[str], bucket: Column, **columns: str) -> DataFrame:
    """The rows with columns of the row before them: ``name="column"``."""
    seen = with_context(rows, key, order, bucket)
    return without_context(seen.withColumns({name: F.lag(c).over(line(key, order)) for name, c in columns.items()}))


def carried(dealt: DataFrame, totals: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with what ``totals`` has for their (key, bucket)."""
    named = totals.select(*[F.col(n).alias(f"{n}_of") for n in (*key, BUCKET)], *columns)
    on = reduce(lambda x, y: x & y, [dealt[n].eqNullSafe(named[f"{n}_of"]) for n in (*key, BUCKET)])
    return dealt.join(named, on).drop(*[f"{n}_of" for n in (*key, BUCKET)])


def running(rows: DataFrame, key: list[str], order: list[str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """The rows with running sums of values over all rows of their key up to them."""
    dealt = rows.withColumn(BUCKET, bucket)
    earlier = Window.partitionBy(*key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*key, BUCKET).agg(*[F.sum(v).alias(f"{n}_in") for n, v in sums.items()])
    totals = totals.select(*key, BUCKET, *[F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums])
    here = line(key, order).rowsBetween(Window.unboundedPreceding, 0)
    found = carried(dealt, totals, key, [f"{n}_before" for n in sums])
    return found.withColumns({n: F.col(f"{n}_before") + F.coalesce(F.sum(v).over(here), F.lit(0)) for n, v in sums.items()}).drop(*[f"{n}_before" for n in sums], BUCKET)


def greatest_before(rows: DataFrame, key: list[str], order: list[str], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """The rows with the greatest of values over all rows of their key before them; null if there is none."""
    dealt = rows.withColumn(BUCKET, bucket)
    earlier = Window.partitionBy(*key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*key, BUCKET).agg(*[F.max(v).alias(f"{n}_in") for n, v in values.items()])
    tops = tops.select(*key, BUCKET, *[F.max(f"{n}_in").over(earlier).alias(f"{n}_before") for n in values])
    here = line(key, order).rowsBetween(Window.unboundedPreceding, -1)
    found = carried(dealt, tops, key, [f"{n}_before" for n in values])
    return found.withColumns({n: F.greatest(F.max(v).over(here), F.col(f"{n}_before")) for n, v in values.items()}).drop(*[f"{n}_before" for n in values], BUCKET)


def equity_curve(rows: DataFrame, key: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """The rows with ``equity``, the running sum of a value, and ``peak``, the greatest equity so far, 0 at least.

    One scan: a bucket is reduced to its sum and the greatest sum of its first rows.
    """
    dealt = rows.withColumn(BUCKET, bucket)
    here = line(key, order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("sum_", F.sum(value).over(here))
    parts = inside.groupBy(*key, BUCKET).agg(F.sum(value).alias("all_"), F.max("sum_").alias("top_"))
    earlier = Window.partitionBy(*key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("equity_before", F.coalesce(F.sum("all_").over(earlier), F.lit(0.0)))
    parts = parts.withColumn("peak_before", F.greatest(F.lit(0.0), F.max(F.col("equity_before") + F.col("top_")).over(earlier)))
    found = carried(inside, parts, key, ["equity_before", "peak_before"]).withColumn("equity", F.col("equity_before") + F.col("sum_"))
    return found.withColumn("peak", F.greatest("peak_before", F.max("equity").over(here))).drop("equity_before", "peak_before", "sum_", BUCKET)


def segments(rows: DataFrame, key: list[str], at: str, order: list[str], gap: int, bucket: Column) -> DataFrame:
    """The rows with the ``gap`` from the row before and the number of their ``segment``, which a longer gap begins."""
    before = previous(rows, key, order, bucket, before_=at).drop(BUCKET).withColumn("gap", F.col(at) - F.col("before_")).drop("before_")
    fresh = F.when(F.col("gap") > gap, 1).otherwise(0)
    return running(before, key, order, bucket, {"segment": fresh})


def within(rows: DataFrame, key: list[str], at: str, width: int, name: str) -> DataFrame:
    """The rows with how many of their key lie in the ``width`` units up to them, their own instant included.

    Buckets are as long as the span, so a row's own and the one before hold all that it counts.
    """
    dealt = rows.withColumn(BUCKET, span(at, width))
    both = dealt.withColumn(CONTEXT, F.lit(False)).unionByName(dealt.withColumns({BUCKET: F.col(BUCKET) + 1, CONTEXT: F.lit(True)}))
    seen = Window.partitionBy(*key, BUCKET).orderBy(at).rangeBetween(-width, 0)
    return without_context(both.withColumn(name, F.count("*").over(seen))).drop(BUCKET)
