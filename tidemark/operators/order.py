"""Positions in a global order without bringing all rows into one task, and splits by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def positioned(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """The rows with their place from 0 in ascending order; ``order`` must tell all rows apart.

    Rows are dealt by ranges and ranked inside them; only the size of each range is added up in one
    place. The ranges are kept by a checkpoint, so both readers see the same ones.
    """
    part, local = "__part", "__local"
    dealt = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))  # a row for each range
    ranked = dealt.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before), part).withColumn(name, F.col("before") + F.col(local)).drop(part, local, "before")


def slice_of(position: Column, n: Column, slices: int) -> Column:
    """Which of the slices [floor(i n / w), floor((i + 1) n / w)) a place lies in."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.floor(i * n / slices))
    return F.size(F.filter(starts, lambda s: s <= position)) - 1


def evenly_spaced(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """At most k rows spread evenly: places round(i (n - 1) / (k - 1)), halves to even; few rows all stay."""
    if not 1 <= k <= 10:
        raise ValueError("between 1 and 10 rows can be asked for")
    placed = positioned(rows, order)
    n = rows.count()
    if n <= k:
        return placed
    wanted = [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    return placed.where(F.col("position").isin(wanted))


def allocation(groups: int, shares: tuple[int, ...] = (70, 15, 15)) -> list[int]:
    """Whole groups by percent: floors, then one more to the largest remainders, the first of equals."""
    counts = [groups * s // 100 for s in shares]
    for i in sorted(range(len(shares)), key=lambda i: (-(groups * shares[i] % 100), i))[: groups - sum(counts)]:
        counts[i] += 1
    return counts


def quotas(groups: int, shares: tuple[float, ...] = (0.7, 0.15, 0.15)) -> list[int]:
    """One group for each split first, the rest by largest remainder; fewer than three all go to the first."""
    if groups < len(shares):
        return [groups, *[0] * (len(shares) - 1)]
    rest = groups - len(shares)
    raw = [rest * s for s in shares]
    counts = [1 + int(x) for x in raw]
    for i in sorted(range(len(shares)), key=lambda i: (int(raw[i]) - raw[i], i))[: groups - sum(counts)]:
        counts[i] += 1
    return counts


def split_groups(groups: DataFrame, order: list[str], counts: list[int], names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The groups with the split that their place gives them."""
    out, top = F.lit(names[-1]), sum(counts[:-1])
    for name, n in zip(reversed(names[:-1]), reversed(counts[:-1]), strict=True):
        out = F.when(F.col("position") < top, name).otherwise(out)
        top -= n
    return positioned(groups, order).withColumn("split", out).drop("position")


def chronological_group_split(rows: DataFrame, group: list[str], at: str) -> DataFrame:
    """(group, split): whole groups by their first instant; empty if a split would get none."""
    groups = rows.groupBy(*group).agg(F.min(at).alias("first_at"))
    counts = allocation(groups.count())
    return split_groups(groups, ["first_at", *group], counts) if min(counts) else groups.withColumn("split", F.lit(None).cast("string")).limit(0)


def guarded_split(rows: DataFrame, at: str, gap: int, cuts: tuple[float, float] = (0.5, 0.75)) -> DataFrame:
    """The rows of three parts by place, each ``gap`` away from the borders, with ``part``.

    Borders are the instants at the places n/2 and 3n/4; what lies within the gap belongs to none.
    """
    placed = positioned(rows, [at])
    n = rows.count()
    first = max(1, int(n * cuts[0]))
    second = max(first + 1, int(n * cuts[1]))
    borders = dict(placed.where(F.col("position").isin(first, second)).select("position", at).collect())
    if len(borders) < 2:
        raise ValueError("too few rows for three parts")
    a, b = borders[first], borders[second]
    part = F.when((F.col("position") < first) & (F.col(at) < a - gap), "development").when((F.col("position") >= first) & (F.col("position") < second) & (F.col(at) >= a + gap) & (F.col(at) < b - gap), "validation")
    part = part.when((F.col("position") >= second) & (F.col(at) >= b + gap), "unseen")
    return placed.withColumn("part", part).where("part is not null").drop("position")
