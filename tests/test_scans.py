"""Carried scans and refined quantiles against loops, whatever the buckets, and with one key for all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles, replay, scans

rng = random.Random(5)


def ticks(keys, n):
    at = 0
    out = []
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 3, 40])
        out.append((rng.choice(keys), at, i, rng.choice([-3.0, -1.0, 0.5, 2.0, 4.0])))
    return out


@pytest.fixture(scope="module", params=[["hot"], ["a", "b", None]], ids=["one key", "keys"])
def rows(request, spark):
    data = ticks(request.param, 400)
    return data, spark.createDataFrame(data, "k string, us bigint, i bigint, v double").repartition(5).persist()


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def key(x):
    return sorted(x, key=repr)


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_previous_and_context(rows, width):
    data, df = rows
    found = scans.previous(df, ["k"], ["us", "i"], scans.span("us", width), p="i")
    want = [(r[2], q[n - 1][2] if n else None) for q in by_key(data).values() for n, r in enumerate(q)]
    assert key((r.i, r.p) for r in found.collect()) == key(want)
    seen = scans.with_context(df, ["k"], ["us", "i"], scans.span("us", width), tail=9)
    last9 = F.sum("v").over(scans.line(["k"], ["us", "i"]).rowsBetween(-9, 0))
    want = [(r[2], sum(x[3] for x in q[max(0, n - 9) : n + 1])) for q in by_key(data).values() for n, r in enumerate(q)]
    assert key((r.i, r.s) for r in scans.without_context(seen.withColumn("s", last9)).collect()) == key(want)


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_running_scans(rows, width):
    data, df = rows
    bucket = scans.span("us", width)
    sums, tops, curve, parts = {}, {}, {}, {}
    for q in by_key(data).values():
        total, peak, best, part, before = 0.0, 0.0, None, 0, None
        for _, us, i, v in q:
            tops[i] = best
            best = v if best is None else max(best, v)
            total += v
            peak = max(peak, total)
            sums[i], curve[i] = total, (total, peak)
            part += before is not None and us - before > 10
            parts[i], before = part, us
    order = ["us", "i"]
    assert {r.i: r.s for r in scans.running(df, ["k"], order, bucket, {"s": F.col("v")}).collect()} == sums
    assert {r.i: r.m for r in scans.greatest_before(df, ["k"], order, bucket, {"m": F.col("v")}).collect()} == tops
    assert {r.i: (r.equity, r.peak) for r in scans.equity_curve(df, ["k"], order, bucket, "v").collect()} == curve
    assert {r.i: r.segment for r in scans.segments(df, ["k"], "us", order, 10, bucket).collect()} == parts


@pytest.mark.parametrize("width", [1, 30])
def test_counts_within_a_span(rows, width):
    data, df = rows
    want = {r[2]: sum(1 for x in data if x[0] == r[0] and r[1] - width <= x[1] <= r[1]) for r in data}
    assert {r.i: r.n for r in scans.within(df, ["k"], "us", width, "n").collect()} == want


def test_no_window_takes_a_whole_key(spark, rows):
    """Windows by key alone see a row for each bucket; those over rows also part by the bucket."""
    plan = scans.previous(rows[1], ["k"], ["us", "i"], scans.span("us", 7), p="i")._jdf.queryExecution().optimizedPlan().toString()
    for part in [x for x in plan.splitlines() if "Window [" in x]:
        assert "bucket_" in part.split("windowspecdefinition(")[1].split("ASC")[0]


def pick(values, kind, p):
    v, n = sorted(values), len(values)
    if kind == "nearest":
        return v[max(0, math.ceil(p * n) - 1)]
    if kind == "upper":
        return v[n // 2]
    at = p * (n - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if at == math.floor(at) else a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("cells", [2, 50, 4096])
def test_quantiles_against_sorting(spark, cells):
    data = {
        "hot": [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 300,
        None: [rng.choice([1.0, 2.0]) for _ in range(40)],
        "one": [7.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"a": quantiles.nearest(0.5), "b": quantiles.nearest(0.95), "c": quantiles.linear(0.25), "d": quantiles.linear(0.5), "e": quantiles.UPPER, "f": quantiles.nearest(0.0), "g": quantiles.linear(1.0)}
    found = {r.k: r for r in quantiles.exact(df, ["k"], "v", wanted, cells).collect()}
    assert set(found) == set(data)
    for k, values in data.items():
        for name, how in wanted.items():
            assert found[k][name] == pytest.approx(pick(values, *how), rel=1e-12), (k, name)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(101).selectExpr("cast(id as double) v")
    assert quantiles.exact(df, [], "v", {"m": quantiles.UPPER}).collect()[0].m == 50.0
    assert quantiles.exact(df.where("v < 0"), ["v"], "v", {"m": quantiles.UPPER}).collect() == []


def test_draws_are_with_replacement(spark):
    """Every draw has as many clusters as there are; each is drawn once on average, and as often as a binomial says."""
    rows = spark.createDataFrame([(k, c, float(c), 1) for k, n in (("a", 40), ("b", 3)) for c in range(n)], "k string, c int, s double, n int").repartition(4)
    drawn = replay.resampled(rows, "k", "c", 500, 7)
    counts = drawn.groupBy("k", "draw").agg(F.sum("n").alias("w")).groupBy("k").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.count("*").alias("draws")).collect()
    assert {r.k: (r.least, r.most, r.draws) for r in counts} == {"a": (40, 40, 500), "b": (3, 3, 500)}
    each = {(r.k, r.s): r.n for r in drawn.groupBy("k", "s").agg(F.count("*").alias("n")).collect()}
    assert all(400 < each["a", float(c)] < 600 for c in range(40))
    twice = drawn.where("k = 'a'").groupBy("draw").agg(F.count_distinct("s").alias("d")).agg(F.avg("d")).first()[0]
    assert twice == pytest.approx(40 * (1 - (39 / 40) ** 40), rel=0.02)


def test_intervals_cover(spark):
    """Of intervals of 95 percent over groups of clusters about that many hold the true mean."""
    r = random.Random(3)
    rows = [(g, h, r.gauss(1.0, 1.0) + c) for g in range(60) for h in range(30) for c in (r.gauss(0, 1),) for _ in range(3)]
    df = spark.createDataFrame(rows, "g int, h int, v double")
    found = replay.cluster_bootstrap(df, "h", "v", "g", draws=1000).collect()
    assert len(found) == 60 and sum(x.lower <= 1.0 <= x.upper for x in found) >= 49


def test_tick_features_of_repeated_instants(spark, tmp_path):
    """Two ticks of one instant divide by zero seconds: the SQL has infinities and NaN there, and so has the query."""
    import math

    import duckdb

    from tidemark import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(catalog.ORACLE["tick_features_w20"])
    names = [d[0] for d in found.description]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else v
    want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in names]) for r in catalog.QUERIES["tick_features_w20"](spark, str(tmp_path)).collect())
    assert got == want
