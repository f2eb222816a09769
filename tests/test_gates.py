"""Gates, exits, splits and intake by hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, text
from tidemark.operators import exits, gates, intake, order


def one(spark, column, *values, kind="string"):
    """What a column of a function makes of each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_instants_must_name_utc(spark):
    us = lambda c: F.unix_micros(clock.utc_instant(c))
    at = 1_767_225_600_000_000
    assert one(spark, us, "2026-01-01T00:00:00Z", "2026-01-01 00:00:00.5+00:00", "2026-01-01T00:00:00", "2026-01-01T00:00:00+02:00", "2026-13-01T00:00:00Z", "", None) == [at, at + 500_000, None, None, None, None, None]
    assert one(spark, lambda c: clock.epoch_us(c, None, 7200), 0, 7200, 1, None, kind="bigint") == [None, 0, -7_199_000_000, None]
    assert one(spark, lambda c: clock.epoch_us(F.lit(5), c), 0, 1500, None, kind="bigint") == [5_000_000, 1_500_000, 5_000_000]
    days = [dt.date(2026, 11, d) for d in (27, 28, 29, 30)]
    assert one(spark, clock.next_weekday, *days, kind="date") == [days[0], days[3], days[3], days[3]]
    assert one(spark, lambda c: clock.in_window(c, 10, 20, 20 + 86_400_000_000), 9, 10, 20 + 86_399_999_999, 20 + 86_400_000_000, None, kind="bigint") == [False, True, True, False, True]


def test_symbols_and_ratings(spark):
    assert one(spark, text.path_component, "GC=F", "^GSPC", "../x", ".", "..", "", "A" * 32, "A" * 33, "é", None) == ["GC=F", "^GSPC", None, None, None, None, "A" * 32, None, None, None]
    assert one(spark, text.canonical_symbol, "gold", "xauusd+", "BTC-USDT", "usdjpy", "USDXXX", "aapl", " ", None) == ["GC=F", "GC=F", "BTC-USD", "USDJPY=X", "USDXXX", "AAPL", " ", None]
    assert one(spark, text.rating, "Rating: **Overweight**", "We buy.\nRATING - sell", "Rating: none\nhold on", "a Buyer", None) == ["Overweight", "Sell", "Hold", None, None]
    assert one(spark, text.rating, "We would sell.\nRating：Overweight", "ＢＵＹ it", "Ｒating﹕ **hold**") == ["Overweight", "Buy", "Hold"]
    assert one(spark, text.canonical_symbol, "\tgold\n", "\u2003xau\u00a0", "\t\n") == ["GC=F", "GC=F", "\t\n"]
    assert one(spark, text.rating_action, "Underweight", "BUY ", "REVIEW", None) == ["SELL", "BUY", None, None]
    assert one(spark, text.words, "Re-test_of Ölpreis -x", None) == [["re-test_of", "ölpreis", "x"], []]
    assert one(spark, text.unicode_form("NFKC", True), "Ｓｔｒａßｅ", None) == ["strasse", None]


def test_search_gate_by_rules(spark):
    kind = "experience_id int, tombstoned int, aliases int, current_aliases int, symbol string, profile string, timeframe string, tier string, accepted boolean, conflict boolean, provenance_valid boolean, action string, snapshot_us bigint, completed_us bigint, cohort int, schema_version string, extractor_version string"
    good = [0, 0, 1, 1, "S", "P", "T", "A", True, False, True, "BUY", 5, 6, 1, "v", "x"]
    changes = [{}, {1: None}, {2: 0}, {4: None}, {5: "Q"}, {6: None}, {7: None}, {7: "C"}, {9: True}, {8: None}, {11: "SELL"}, {1: 1}, {3: 0}, {13: None}, {13: 10}, {14: 2}, {15: "w"}, {16: "y"}]
    rows = spark.createDataFrame([[i, *[c.get(k, v) for k, v in enumerate(good)][1:]] for i, c in enumerate(changes)], kind)
    now = ["tombstone", "tombstone", "symbol", "profile", "timeframe", "trust_tier", "trust_tier", "provenance", "provenance", "action"]
    want = [None, *now, None, None, "as_of", "as_of", "cohort", "feature_schema", "feature_extractor"]
    assert [r.reason for r in gates.search_gate(rows, "S", "P", "T", action="BUY", as_of_us=10).orderBy("experience_id").collect()] == want
    assert [r.reason for r in gates.search_gate(rows, "S", "P", "T", action="BUY").orderBy("experience_id").collect()] == [None, *now, "tombstone", "tombstone", None, None, "cohort", "feature_schema", "feature_extractor"]
    assert gates.search_gate(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        gates.search_gate(rows, tiers=("C",))


def test_risk_codes_in_order(spark):
    kind = "i int, action string, expired boolean, sessions array<string>, session string, age_s double, spread_points double, slippage_points double, daily_loss double, drawdown double, losses_in_row int, exposure double"
    bad = ["ENTER_LONG", True, ["ASIA"], "x", 9.0, 9.0, 9.0, 9.0, 9.0, 9, 9.0]
    good = ["ENTER_LONG", False, [], "x", 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0]
    codes = ["PLAN_EXPIRED", "SESSION_LIMIT", "STALE_TICK", "SPREAD_LIMIT", "SLIPPAGE_LIMIT", "DAILY_LOSS_LIMIT", "DRAWDOWN_LIMIT", "CONSECUTIVE_LOSS_LIMIT", "EXPOSURE_LIMIT", "ACCEPTED"]
    heal = [1, 2, 4, 5, 6, 7, 8, 9, 10]
    rows = [[i, *[good[k] if k in heal[:i] else v for k, v in enumerate(bad)]] for i in range(10)] + [[10, "EXIT", False, *bad[2:]]]
    run = lambda **more: [(r.code, r.allowed) for r in gates.risk_verdict(spark.createDataFrame(rows, kind), 5, 5, 5, 5, 5, 5, 5, **more).orderBy("i").collect()]
    assert run() == [(c, c == "ACCEPTED") for c in codes] + [("NON_ENTRY", True)]
    assert run(enforce_losses=False)[5] == ("EXPOSURE_LIMIT", False)


def test_scanned_documents(spark):
    rows = [("text", 64, False)] * 5 + [("scan", 0, True)] * 5 + [("mixed", 100, True)] + [("mixed", 5, True)] * 4 + [("few", 100, True)] + [("few", 5, True)] * 9 + [("blank", 0, False)] + [("one", 0, True), ("one", 0, False), ("one", 0, False)]
    got = {r.d: r.state for r in gates.scan_states(spark.createDataFrame(rows, "d string, c int, i boolean"), "d", "c", "i").collect()}
    assert got == {"text": "PARSED", "scan": "NEEDS_OCR", "mixed": "PARSED", "few": "NEEDS_OCR", "blank": "PARSED", "one": "NEEDS_OCR"}


def test_market_opens_only_by_validation(spark):
    kind = "s int, i int, calendar string, terminal boolean, account boolean, fresh boolean, error string, require_validation boolean, validated boolean"
    ok = ["OPEN", True, True, True, None, False, False]
    v = {6: True}
    changes = [{}, v, {}, {3: False}, {}, v, {0: "CLOSED", 3: False}, {0: "CLOSED"}, {**v}, {}, {5: True}, {5: True, **v}, {}, {4: "STALE_DATA"}, {4: "oops"}, {1: False}, {0: "UNKNOWN"}, {}]
    rows = spark.createDataFrame([[1, i, *[c.get(k, x) for k, x in enumerate(ok)]] for i, c in enumerate(changes)], kind)
    got = [r.state for r in gates.market_states(rows, "s", ["i"], F.floor(F.col("i") / 3)).orderBy("i").collect()]
    o, p = "OPEN", "OPENING_VALIDATION"
    assert got == [p, p, o, "UNKNOWN", p, p, "CLOSED", p, p, o, p, p, o, "UNKNOWN", "DATA_ERROR", "DATA_ERROR", "UNKNOWN", p]


@pytest.mark.parametrize("n,want", [(3, [0, 1, 2]), (30, [0, 7, 14, 22, 29]), (33, [0, 8, 16, 24, 32])])
def test_evenly_spaced_rounds_halves_to_even(spark, n, want):
    rows = spark.range(n).select(F.col("id").alias("x")).repartition(5)
    assert sorted(r.x for r in order.evenly_spaced(rows, ["x"], 5).collect()) == want
    assert [r.x for r in order.evenly_spaced(rows, ["x"], 1).collect()] == [0] or n <= 1


def test_slices_and_allocations(spark):
    rows = order.positioned(spark.range(33).select((F.col("id") * 3).alias("x")).repartition(4), ["x"])
    got = [0] * 6
    for r in rows.withColumn("w", order.slice_of(F.col("position"), F.lit(33), 6)).collect():
        assert r.x == 3 * r.position
        got[r.w] += 1
    assert got == [int((i + 1) * 33 / 6) - int(i * 33 / 6) for i in range(6)]
    assert [order.allocation(n) for n in (3, 7, 10, 20)] == [[2, 1, 0], [5, 1, 1], [7, 2, 1], [14, 3, 3]]
    assert [order.quotas(n) for n in (2, 3, 10)] == [[2, 0, 0], [1, 1, 1], [6, 2, 2]]
    days = spark.createDataFrame([(f"g{i}", 100 - i) for i in range(10)] + [("g0", 1)], "g string, at int")
    split = {r.g: r.split for r in order.chronological_group_split(days, ["g"], "at").collect()}
    assert [split[f"g{i}"] for i in (0, 9, 8, 4, 3, 2, 1)] == ["train", "train", "train", "train", "validation", "validation", "test"]
    assert order.chronological_group_split(days.where("g < 'g3'"), ["g"], "at").count() == 0


TICK = {"us": 0, "bid": 100.0, "ask": 100.1, "point": 0.1, "momentum": 0.0, "persistence": 0.0, "spread_expansion": 0.0, "volatility": 0.0, "active": True, "longs": True, "shorts": True, "signal": 1, "expected": 20.0, "strategy": "momentum"}


def at(points, **more):
    return {"bid": 100.1 + points / 10, "ask": 100.2 + points / 10, **more}


BACK = {"momentum": -1.0, "persistence": 0.5}
#: Ticks after one that opens a long position at 100.1, and the reasons that close it.
PATHS = [
    ([{"bid": 0.0}], "POSITION_PRICE_UNAVAILABLE"), ([at(-100.5, active=False)], "EMERGENCY_BROKER_STOP"), ([{"active": False}], "STRATEGIC_REGIME_INVALIDATED"), ([{"longs": False}], "STRATEGIC_REGIME_INVALIDATED"),
    ([{"ask": 104.2}], "SPREAD_BLOWOUT"), ([{"spread_expansion": 1.1}], "SPREAD_BLOWOUT"), ([{"volatility": 0.006}], "VOLATILITY_BLOWOUT"), ([at(30.5)], "TAKE_PROFIT"), ([at(-20.5)], "MAE_STOP"), ([at(21), at(10.5)], "MFE_GIVEBACK"),
    ([at(12), at(8.5, **BACK)], "MICRO_REVERSAL"), ([at(-6, **BACK)], "STRATEGY_INVALIDATION"), ([at(-2, **BACK)], "MOMENTUM_REVERSAL"), ([{"us": 13_000_000}], "NO_PROGRESS"), ([at(11, us=1), at(11, us=46_000_000)], "MAX_DURATION"),
    ([at(5), at(9)], None), ([{"signal": -1, "strategy": "range_rejection"}], None), ([at(-2, **BACK, strategy="x")], "MOMENTUM_REVERSAL"),  # the rules are those of the strategy that opened it
]


def test_thirteen_exits(spark):
    """A symbol for each path; only the first tick of it opens a position."""
    rows = [(s, *[{**TICK, **({} if i == 0 else {"signal": 0}), "us": i * 1_000_000, **c}[n] for n in exits.COLUMNS]) for s, (path, _) in enumerate(PATHS) for i, c in enumerate([{}, *[{**x, "signal": 0} for x in path]])]
    found = {r.symbol: r.reason for r in exits.replayed(spark.createDataFrame(rows, "symbol bigint, " + exits.TICK)).collect()}
    assert {s: found.get(s) for s in range(len(PATHS))} == {s: why for s, (_, why) in enumerate(PATHS)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_positions_are_taken_one_at_a_time(spark, seed):
    import random

    rng = random.Random(seed)
    could = [(s, t * 10, None if rng.random() < 0.02 else t * 10 + rng.choice([1, 15, 40, 200])) for s in range(3) for t in sorted(rng.sample(range(300), 120))]
    want = set()
    for s in range(3):
        free = -1
        for k, since, end in could:
            if k == s and since > free:
                want.add((s, since))
                free = 1 << 62 if end is None else end
    rows = spark.createDataFrame(could, "symbol bigint, since bigint, exit_us bigint").repartition(3)
    assert {tuple(r) for r in exits.taken(rows, span_us=500).collect()} == want


def test_stream_of_positions_equals_the_replay(spark, tmp_path):
    rows = []
    for i in range(240):
        tick = {**TICK, "us": i * 1_000_000, "bid": 100 + (i * 37 % 41) / 10, "momentum": (i % 7) - 3.0, "persistence": i % 10 / 10, "signal": (i % 5) - 2, "strategy": "momentum" if i % 2 else "range"}
        rows.append((i % 2, *[{**tick, "ask": tick["bid"] + 0.1}[c] for c in exits.COLUMNS]))
    kind = "symbol bigint, " + exits.TICK
    ticks = spark.createDataFrame(rows, kind)
    want = sorted(map(tuple, exits.replayed(ticks).collect()))
    assert len(want) > 10 and len({w[-1] for w in want}) >= 4
    for part in range(3):
        ticks.where(f"us >= {part * 80_000_000} and us < {(part + 1) * 80_000_000}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        # each part is a query of its own that goes on from the state of the one before
        source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = exits.streamed(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_intake_of_files(spark, tmp_path):
    folder = tmp_path / "src"
    (folder / "sub").mkdir(parents=True)
    for name, body in (("a.md", "one"), ("b.md", "two"), ("sub/c.md", "one"), ("x.bin", "no")):
        (folder / name).write_text(body)
    files = intake.inventory(spark, str(folder), "*.md")
    assert files.count() == 3 and {r.path.rsplit("/", 1)[1] for r in intake.distinct_sources(files).collect()} == {"a.md", "b.md"}
    before = spark.createDataFrame(files.collect(), files.schema)
    (folder / "b.md").write_text("changed")
    (folder / "sub/c.md").unlink()
    (folder / "d.md").write_text("new")
    after = intake.inventory(spark, str(folder), "*.md")
    assert {r.path.rsplit("/", 1)[1]: r.change for r in intake.inventory_changes(after, before).collect()} == {"a.md": "SAME", "b.md": "CHANGED", "c.md": "REMOVED", "d.md": "NEW"}
    with pytest.raises(RuntimeError, match="b.md"):
        intake.unchanged(before, after)
    assert intake.unchanged(before, before).count() == 3
    (tmp_path / "i.csv").write_text("time,Other, RSI\n2026-01-03,1,50\nbad,1,2\n2026-01-01,3,40.5\n2026-02-01,9,9\n")
    got = intake.indicator(spark, str(tmp_path / "i.csv"), "rsi", "2026-01-01", "2026-01-31").collect()
    assert [(str(r.date), r.value) for r in got] == [("2026-01-01", "40.5"), ("2026-01-03", "50")]
    assert intake.indicator(spark, str(tmp_path / "i.csv"), "unheard", "2026-01-01", "2026-01-01").first().value == "3"
    with pytest.raises(ValueError, match="MACD"):
        intake.indicator(spark, str(tmp_path / "i.csv"), "macd", "2026-01-01", "2026-01-31")


def test_nested_markets_and_merges(spark):
    body = '{"events":[{"title":"t","markets":[{"question":"a","closed":false,"endDate":"2030-01-01T00:00:00Z","outcomePrices":"[\\"0.5\\"]","outcomes":"[\\"Yes\\"]","volumeNum":3},{"question":"b","closed":true},{"question":"c","outcomePrices":"[]","outcomes":"[\\"x\\"]"}]},{"title":"u"}]}'
    found = intake.markets(spark.createDataFrame([(body,), ("damaged",), (None,)], "body string"))
    assert sorted(r.question for r in found.collect()) == ["a", "b", "c"]
    assert [r.question for r in gates.open_markets(found, 0).collect()] == ["a"] and gates.open_markets(found, 1 << 60).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, float("nan")])], "doc_id int, embedding array<double>")
    with pytest.raises(ValueError):
        intake.write_vectors(vectors, "unused", 2)
    safe = spark.createDataFrame([({"note": "fine", "api_key": "x", "about": "my Password"},)], "m map<string,string>").select(intake.safe_map("m").alias("m")).first().m
    assert safe == {"note": "fine"}
    some, none = vectors, vectors.limit(0)
    assert intake.bundle({"a": some, "b": some}) == ("COMPLETE", {"a": "AVAILABLE", "b": "AVAILABLE"})
    assert intake.bundle({"a": some, "b": none, "c": None})[0] == "PARTIAL" and intake.bundle({"a": None}, ("a",))[0] == "UNAVAILABLE"
    assert intake.first_source([none, some]).count() == 1
    with pytest.raises(Exception, match="identity"):
        intake.canonical(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"], {"x": ["a"]}).collect()


def test_volumes_and_stops(spark):
    from tidemark.operators import reports

    lots = lambda v: one(spark, lambda c: reports.lots(c, "0.01", "5", "0.01", "2"), *v, kind="double")
    assert lots([0.029, 3.0, 0.001, 0.0, -1.0, None]) == [0.02, 2.0, 0.01, None, None, None]
    assert one(spark, lambda c: reports.lots(c, "0.25", "9", "0.1", "9"), 0.1, 0.27, 0.39, kind="double") == [0.3, 0.3, 0.3]
    kind = "d string, e double, s double, t double"
    rows = [("LONG", 10.0, 9.0, 11.0), ("LONG", 10.0, 9.9, 11.0), ("LONG", 10.0, 9.0, 10.2), ("SHORT", 10.0, 11.0, 9.0), ("SHORT", 10.0, 9.0, 8.0), ("FLAT", 10.0, 9.0, 8.0), ("LONG", 10.0, -1.0, 11.0)]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.select(reports.stop_fault(F.col("d"), F.col("e"), F.col("s"), F.col("t"), F.lit(0.5))).collect()]
    assert got == [None, "STOP_LOSS", "TAKE_PROFIT", None, "STOP_LOSS", "DIRECTION", "PRICE"]


def test_calendar_by_local_minutes(spark):
    from tidemark.operators import reports

    at = ["2024-01-08 14:29", "2024-01-08 14:30", "2024-01-08 20:59", "2024-01-08 21:00", "2024-01-13 15:00", "2024-01-15 15:00", "2024-01-16 15:00", "2024-01-16 18:00", "2025-01-01 15:00"]
    rows = spark.createDataFrame([(i, int(dt.datetime.fromisoformat(t + "+00:00").timestamp()) * 1_000_000) for i, t in enumerate(at)], "i int, us bigint")
    week = {d: [(570, 960)] for d in range(5)}
    got = reports.calendar_status(rows, "us", "America/New_York", week, ["2024-01-15"], {"2024-01-16": [(570, 780)], "2024-01-15": [(0, 1440)]}, ("2024-01-01", "2024-12-31")).orderBy("i").collect()
    assert [r.status for r in got] == ["CLOSED", "OPEN", "OPEN", "CLOSED", "CLOSED", "CLOSED", "OPEN", "CLOSED", "UNKNOWN"]
    with pytest.raises(ValueError):
        reports.calendar_status(rows, "us", "UTC", {0: [(600, 600)]}, [], {}, ("2024-01-01", "2024-12-31"))


def test_weighted_masked_distance(spark):
    from tidemark.operators import similarity

    rows = spark.createDataFrame([([1.0, None, 3.0, 5.0], [0.0, 1.0, 1.0, 5.0])], "a array<double>, b array<double>")
    got = rows.select(similarity.masked_distance("a", "b", 2, "array(1D, 9D, 2D, 1D)").alias("d"), similarity.masked_distance("a", "b", 4).alias("n")).first()
    assert abs(got.d - (9 / 4) ** 0.5) < 1e-12 and got.n is None
