"""As-of and range joins without range explosion.

Both sides are dealt by (key, time bucket); the bucket is as long as the tolerance, so a probe needs
its own bucket and one neighbour, and a hot key spreads over its buckets. Inside a bucket one sorted
pass carries the nearest quote (union and window), or an equi-join is filtered (ranges). Where only the
greatest and the least value in a range is asked for, ranges meet blocks of points, not points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, quotes: DataFrame, key: str, at: str, us: str, values: list[str], tolerance_us: int, forward: bool = True, prefix: str = "q_") -> DataFrame:
    """Each probe with the first quote at or after it (or the last at or before), within a tolerance.

    ``at`` is the probe's time and ``us`` the quote's, in microseconds. A quote at the probe's own
    instant counts. Of quotes of one instant the least by ``values`` is taken. Probes without a
    quote, or with a null time or key, keep nulls. Added columns: prefix + us and each value.
    """
    step = F.lit(tolerance_us + 1)
    bucket = lambda c: F.floor(F.col(c) / step)
    packed = F.struct(F.col(us).alias("us"), *[F.col(v).alias(v) for v in values])
    once = quotes.where(F.col(us).isNotNull()).groupBy(key, us).agg(F.min(F.struct(*values)).alias("v")).select(key, us, *[F.col(f"v.{v}").alias(v) for v in values])
    shift = -1 if forward else 1
    sides = once.select(F.col(key).alias("k"), F.explode(F.array(bucket(us), bucket(us) + shift)).alias("b"), F.col(us).alias("t"), packed.alias("quote"), F.lit(None).cast(_row(probes)).alias("row"))
    asked = probes.select(F.col(key).alias("k"), bucket(at).alias("b"), F.col(at).alias("t"), F.lit(None).cast(sides.schema["quote"].dataType).alias("quote"), F.struct(*probes.columns).alias("row"))
    both = sides.unionByName(asked).withColumn("probe", F.col("row").isNotNull())
    order = Window.partitionBy("k", "b")
    # against the direction looked in, so the frame only grows (one that shrinks is counted anew for each row);
    # a quote of the same instant precedes its probe, and so is seen
    line = order.orderBy(F.desc("t") if forward else F.col("t"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("quote", ignorenulls=True).over(line)
    seen = both.withColumn("found", found).where("probe")
    near = F.abs(F.col("found.us") - F.col("t")) <= tolerance_us
    return seen.select("row.*", *[F.when(near, F.col(f"found.{c}")).alias(prefix + c) for c in ["us", *values]])


def _row(probes: DataFrame) -> str:
    return probes.select(F.struct(*probes.columns).alias("row")).schema["row"].dataType.simpleString()


def in_ranges(ranges: DataFrame, points: DataFrame, key: str, lo: str, hi: str, us: str, longest_us: int) -> DataFrame:
    """Ranges [lo, hi] joined with the points inside, by buckets as long as the longest range."""
    step = F.lit(longest_us + 1)
    cells = ranges.withColumn("b_", F.explode(F.array_distinct(F.array(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step)))))
    return cells.join(points.withColumn("b_", F.floor(F.col(us) / step)), [key, "b_"]).where(F.col(us).between(F.col(lo), F.col(hi))).drop("b_")


def extremes(ranges: DataFrame, points: DataFrame, by: list[str], key: str, lo: str, length: str, lengths: tuple[int, ...], us: str, value: str) -> DataFrame:
    """(by, most, least): the greatest and the least value of the points in [lo, lo + length], over all ranges of one ``by``.

    Blocks are as long as the shortest of the few ``lengths``, so a range ends in a later block than it begins in. Its
    edges are runs from the end and from the beginning of a block, which two sorted passes carry; the whole blocks
    between were reduced to a row each. A point goes to one block, however many ranges hold it.
    """
    step = min(lengths)
    block = lambda c: ((c - F.pmod(c, F.lit(step))) / F.lit(step)).cast("bigint")
    begin, end = F.col(lo), F.col(lo) + F.col(length)
    both = {"most": F.max, "least": F.min}
    seen = points.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(F.col(key).alias("k_"), block(F.col(us)).alias("b_"), F.col(us).alias("t_"), F.col(value).alias("v_"))
    probes = [ranges.select(*by, F.col(key).alias("k_"), block(t).alias("b_"), t.alias("t_"), F.lit(first).alias("first_")) for t, first in ((begin, True), (end, False))]
    rows = seen.unionByName(probes[0].unionByName(probes[1]), allowMissingColumns=True)
    # a point of the probe's instant precedes it in either order, and frames only grow
    probe, line = F.col("first_").isNotNull(), Window.partitionBy("k_", "b_")
    back, on = (line.orderBy(t, probe).rowsBetween(Window.unboundedPreceding, 0) for t in (F.desc("t_"), F.col("t_")))
    edges = rows.select(*by, "first_", *[F.when(F.col("first_"), f("v_").over(back)).otherwise(f("v_").over(on)).alias(n) for n, f in both.items()]).where(probe)
    # of whole blocks between there are as many as the length has, less one, or one more if it isn't a multiple of the step
    counts = sorted({n for x in lengths for n in (x // step - 1, -(-x // step) - 1) if n > 0})
    inner = ranges.select(*by, F.col(key).alias("k_"), block(begin).alias("b_"), (block(end) - block(begin) - 1).alias("n_"))
    found = edges.select(*by, *both)
    if counts:
        whole = seen.groupBy("k_", "b_").agg(*[f("v_").alias(n) for n, f in both.items()])
        blocks = whole.unionByName(inner.select("k_", "b_").distinct(), allowMissingColumns=True).groupBy("k_", "b_").agg(*[f(n).alias(n) for n, f in both.items()])
        after = lambda n: Window.partitionBy("k_").orderBy("b_").rangeBetween(1, n)
        blocks = blocks.select("k_", "b_", *[f(c).over(after(n)).alias(f"{c}_{n}") for n in counts for c, f in both.items()])
        each = [F.struct(F.lit(n).cast("bigint").alias("n_"), *[F.col(f"{c}_{n}").alias(c) for c in both]) for n in counts]
        blocks = blocks.select("k_", "b_", F.explode(F.array(*each)).alias("e_"))
        found = found.unionByName(inner.join(blocks.select("k_", "b_", "e_.*"), ["k_", "b_", "n_"]).select(*by, *both))
    return found.groupBy(*by).agg(*[f(n).alias(n) for n, f in both.items()])
