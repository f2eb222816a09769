"""Small exact cases, look-ahead and order invariance, streams against batches, files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A, pages
from tidemark.operators import corpus, replay, similarity
from tidemark.operators.components import components
from tidemark.operators.outcomes import evaluate_outcomes
from tidemark.sources import files
from tidemark.streaming import ticks as stream

TICKS = "symbol bigint, us bigint, bid double, ask double"
S = 1_000_000


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame([(1, 10 * S, 1.0, 1.1), (1, 20 * S, 1.2, 1.3), (1, 20 * S, 1.1, 1.4), (1, 100 * S, 2.0, 2.1), (2, 15 * S, 5.0, 5.1)], TICKS)


@pytest.mark.parametrize("forward,want", [(True, {0: 10, 10: 10, 11: 20, 21: None, 95: 100, 101: None}), (False, {0: None, 10: 10, 11: 10, 21: 20, 95: None, 101: 100})])
def test_asof_ties_and_tolerance(spark, quotes, forward, want):
    probes = spark.createDataFrame([(1, t * S) for t in want] + [(3, 10 * S), (1, None)], "symbol bigint, at bigint")
    got = {(r.symbol, r.at): (r.q_us, r.q_bid) for r in A.asof(probes, quotes, "symbol", "at", "us", ["bid"], 10 * S, forward).collect()}
    assert {t: got[1, t * S][0] and got[1, t * S][0] // S for t in want} == want
    assert got[3, 10 * S] == (None, None) and got[1, None] == (None, None)
    if forward:
        assert got[1, 11 * S][1] == 1.1  # of one instant the least


def test_asof_agrees_with_a_scan(spark):
    import random

    rng = random.Random(3)
    q = [(rng.randrange(3), rng.randrange(1000)) for _ in range(300)]
    p = [(rng.randrange(3), rng.randrange(1000)) for _ in range(200)]
    quotes, probes = spark.createDataFrame([(k, u, u) for k, u in q], "k bigint, us bigint, v bigint"), spark.createDataFrame([(i, *x) for i, x in enumerate(p)], "i bigint, k bigint, at bigint")
    for forward in (True, False):
        got = {r.i: r.q_us for r in A.asof(probes, quotes, "k", "at", "us", ["v"], 7, forward).select("i", "q_us").distinct().collect()}
        for i, (k, at) in enumerate(p):
            near = [u for kk, u in q if kk == k and (0 <= u - at <= 7 if forward else 0 <= at - u <= 7)]
            assert got[i] == ((min if forward else max)(near) if near else None)


def test_ranges_meet_each_point_once(spark, quotes):
    ranges = spark.createDataFrame([(7, 1, 10 * S, 100 * S), (8, 1, 101 * S, 102 * S)], "id bigint, symbol bigint, lo bigint, hi bigint")
    got = A.in_ranges(ranges, quotes, "symbol", "lo", "hi", "us", 90 * S)
    assert got.where("id = 7").count() == 4 and got.where("id = 8").count() == 0


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [(1, 1, 0, 1.0, 1.1, 0.01, "BUY", 0), (2, 1, 0, 1.0, 1.1, 0.01, "HOLD", None), (3, 2, 0, 5.0, 5.1, 0.01, "SELL", 0)]
    return spark.createDataFrame(rows, "decision_id bigint, symbol bigint, us bigint, bid double, ask double, point double, action string, anchor_us bigint")


def test_outcomes_by_hand(decisions, quotes):
    got = {(r.decision_id, r.horizon): r for r in evaluate_outcomes(decisions, quotes, 200 * S, horizons=(8, 50), tolerance=5).collect()}
    assert got[1, 8].status == "COMPLETE" and got[1, 8].lag_us == 2 * S and got[1, 8].buy_points == pytest.approx(-10) and got[1, 8].best == "TIE"
    assert got[2, 8].status == "INELIGIBLE" and got[1, 50].status == "DATA_UNAVAILABLE" and got[3, 8].status == "DATA_UNAVAILABLE"
    assert got[1, 8].buy_mfe == pytest.approx(-0.1)  # the tick after the target isn't part of the path


def test_later_rows_change_nothing_as_of_now(spark, decisions, quotes):
    later = spark.createDataFrame([(1, 12 * S, 0.1, 9.9), (1, 9 * S + 1, 0.5, 0.6)], TICKS).where("us > 11000000")
    a, b = (sorted(evaluate_outcomes(decisions, q, 11 * S, horizons=(8, 9), tolerance=3).collect(), key=repr) for q in (quotes, quotes.union(later)))
    assert a == b and {r.status for r in a} == {"DATA_UNAVAILABLE", "COMPLETE", "INELIGIBLE", "PENDING"}


def test_order_of_rows_and_partitions_is_irrelevant(spark, quotes, decisions):
    a = evaluate_outcomes(decisions, quotes, 200 * S, horizons=(8, 50), tolerance=5)
    b = evaluate_outcomes(decisions.orderBy(F.rand(1)).repartition(5), quotes.orderBy(F.rand(2)).repartition(7), 200 * S, horizons=(8, 50), tolerance=5)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert components(edges.limit(0)).count() == 0


def test_chunks_and_clusters(spark):
    words = " ".join(f"w{i}" for i in range(130))
    docs = spark.createDataFrame([(1, words), (2, words.upper()), (3, words + " x"), (4, ""), (5, None)], "doc_id bigint, text string")
    got = corpus.chunks(docs.where("doc_id = 1")).orderBy("chunk").collect()
    assert [len(r.text.split()) for r in got] == [64, 64, 34] and got[1].text.split()[0] == "w48"
    clusters = {r.doc_id: r.cluster for r in corpus.duplicate_clusters(docs.where("text is not null")).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 4: 4}


def test_clusters_link_unlike_texts_of_one_set(spark, tmp_path):
    """Texts that repeat a passage another number of times have the same shingles; only the least of them was linked."""
    import duckdb

    from tidemark import catalog

    passage, other = ("a b c d e f g h i j k l " * 3).strip(), " ".join(f"w{i}" for i in range(40))
    texts = [(7, passage), (3, f"{passage} {passage}"), (9, f"{passage} {passage}!"), (5, f"{passage} a b"), (6, other), (8, f"{other} x"), (4, "a b c"), (10, None), (11, None), (12, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(catalog.ORACLE["duplicate_clusters"]).fetchall())
    got = {r.doc_id: r.cluster for r in catalog.QUERIES["duplicate_clusters"](spark, str(tmp_path)).collect()}
    assert got == want == {3: 3, 5: 3, 7: 3, 9: 3, 6: 6, 8: 6, 4: 4, 10: 10, 11: 10, 12: 12}


def test_masked_distance_needs_enough(spark):
    df = spark.createDataFrame([([1.0] * 10, [2.0] * 10), ([1.0] * 10, [2.0] * 7 + [None] * 3)], "a array<double>, b array<double>")
    assert [r.d for r in df.select(similarity.masked_distance("a", "b").alias("d")).collect()] == [1.0, None]


def test_machine_exits_in_order():
    m = replay.Machine(replay.Policy("p", look=1, threshold=1.0, stop=5, target=5, max_ticks=2))
    assert m.step(1, 10, 10.1, False) is None and m.step(2, 12, 12.1, False) is None
    out = m.step(3, 18, 18.1, False)
    assert out["exit_reason"] == "TARGET" and out["pnl"] == pytest.approx(5.9) and m.side == 0


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("c"), (F.col("id") % 7).cast("double").alias("v"), F.lit("x").alias("g"))
    r = replay.cluster_bootstrap(rows, "c", "v", "g").first()
    assert r.lower <= r["mean"] <= r.upper and r.upper - r.lower < 1


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_streams_match_batches(spark, tmp_path):
    rows = [(i, i % 3, t * S, float(i % 11), float(i % 11) + 1) for i, t in enumerate([5, 7, 7, 6, 9, 30, 31, 30, 40, 41] * 6)]
    schema = "arrival bigint, symbol bigint, us bigint, bid double, ask double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    run(stream.accepted(source), "accepted_ticks")
    got = sorted((r.symbol, r.us) for r in spark.table("accepted_ticks").collect())
    want = []
    for s in range(3):
        last = -1
        for _, sym, us, *_ in rows:
            if sym == s and us > last:
                last = us
                want.append((s, us))
    assert got == sorted(want)
    mids = source.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    run(stream.features(mids), "features_ticks")
    assert spark.table("features_ticks").count() == len(rows) and spark.table("features_ticks").agg(F.max("n")).first()[0] == 20
    timed = mids.withColumn("ts", F.timestamp_micros("us"))
    run(stream.bars(timed, "10 seconds", "1 second"), "bars_ticks")
    batch = spark.createDataFrame(rows, schema).groupBy("symbol", F.window(F.timestamp_micros("us"), "10 seconds")).count().where("window.end <= timestamp_micros(40000000)").count()
    assert spark.table("bars_ticks").count() == batch
    run(stream.sessions(timed, "5 seconds", "1 second"), "session_ticks")
    assert spark.table("session_ticks").count() > 0


def test_append_once(spark, tmp_path):
    path, batch = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    for _ in range(2):
        stream.append_once(batch, path, "k")
    assert spark.read.parquet(path).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02T00:00:00-05:00,1,2,0.5,x,10\nbad\n,1,1,1,1,1\n2024-01-03,1,2,0.5,1.5,10\n")
    got = files.ohlcv(spark, str(tmp_path / "p.csv"), "2024-01-02").collect()
    assert len(got) == 1 and str(got[0].date) == "2024-01-02" and got[0].close is None
    tick = {"symbol": "A", "timestamp": "2024-01-01T00:00:00Z", "bid": 1.0, "ask": 1.1, "point": 0.01}
    (tmp_path / "a.jsonl").write_text(json.dumps(tick) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"ticks": [tick, tick]}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps([tick] * 3))
    assert [files.ticks(spark, str(tmp_path / n)).count() for n in ("a.jsonl", "b.json", "c.json")] == [1, 2, 3]
    (tmp_path / "log.md").write_text("[2024-01-01 | AAA | Buy | pending]\nbody one\n---\n[2024-01-02 | BBB | Sell | +3%]\nbody two\n---\n")
    log = files.decision_log(spark, str(tmp_path / "log.md")).orderBy("entry").collect()
    assert [(r.ticker, r.pending, r.body) for r in log] == [("AAA", True, "body one"), ("BBB", False, "body two")]
    with pytest.raises(ValueError, match="missing columns: x"):
        files.require(spark.range(1), ["id", "x"])
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "v bigint, split string")
    files.write_generation(rows, str(tmp_path / "gen"))
    with pytest.raises(Exception, match="already exists"):
        files.write_generation(rows, str(tmp_path / "gen"))
    back = spark.read.schema("v bigint, split string").json(str(tmp_path / "gen"))
    assert files.manifest(back).exceptAll(files.manifest(rows)).count() == 0
    series = spark.createDataFrame([("d1", "1.5", "2024-01-01", "2024-02-01"), ("d1", "1.7", "2024-02-02", "9999"), ("d2", ".", "2024-01-01", "9999")], "date string, value string, realtime_start string, realtime_end string")
    assert {r.date: r.value for r in files.vintage(series, "2024-01-15").collect()} == {"d1": 1.5, "d2": None}


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    for i, name in enumerate(("g1", "g2")):
        files.publish(spark.range(i + 1), root, name)
        assert files.active(spark, root).count() == i + 1


def test_greedy_keeps_what_one_pass_keeps(spark):
    import random

    from tidemark.operators import evidence

    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for n in range(40):
        if not any((k, n) in pairs for k in kept):
            kept.append(n)
    got = evidence.greedy_kept(spark.range(40).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(pairs), "a bigint, b bigint"))
    assert sorted(r.node for r in got.where("kept").collect()) == kept and got.where("kept is null").count() == 0


HTML = """<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><!-- <p>gone</p> --><h1>One</h1><p>first <b>bold</b><br>line<p>second
   line</p><h2>Sub &lt;x&gt;</h2><ul><li>item a</li><li>item b</ul>loose<table><tr><th>name<th>value</tr><tr><td>a</td><td>1</td></tr><tr><td>b &amp;nbsp;</td><td></td></tr></table>
<h3>Deep</h3><p>under three</p><h2>Next</h2><p>under next</p><h1>Two</h1><p>end</p><table><tr><td>only</td></tr></table></body></html>"""


def test_blocks_of_a_page(spark):
    rows = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "plain &quot;text&quot; only"), (5, "<p>open <i>end")], "page_id bigint, html string")
    got = [(r.page_id, r.block, r.kind, r.section, r.text) for r in pages.blocks(rows).orderBy("page_id", "block").collect()]
    sub = "One > Sub <x>"
    want = [
        ("TITLE", "", "A & B"), ("HEADING", "", "One"), ("PROSE", "One", "first bold line"), ("PROSE", "One", "second line"), ("HEADING", "One", "Sub <x>"), ("LIST", sub, "item a"), ("LIST", sub, "item b"), ("PROSE", sub, "loose"),
        ("TABLE", sub, "name | value\na | 1\nb &nbsp; | "), ("HEADING", sub, "Deep"), ("PROSE", f"{sub} > Deep", "under three"), ("HEADING", f"{sub} > Deep", "Next"), ("PROSE", "One > Next", "under next"), ("HEADING", "One > Next", "Two"), ("PROSE", "Two", "end"), ("TABLE", "Two", "only"),
    ]
    assert [g[2:] for g in got if g[0] == 1] == want and [g[1] for g in got if g[0] == 1] == list(range(len(want)))
    assert [g for g in got if g[0] > 1] == [(4, 0, "PROSE", "", 'plain "text" only'), (5, 0, "PROSE", "", "open end")]


def test_chunks_pack_sections_and_repeat_heads(spark):
    rows = [(1, 0, "HEADING", "", "One"), (1, 1, "PROSE", "One", "a b c"), (1, 2, "LIST", "One", "d"), (1, 3, "PROSE", "One", "e f"), (1, 4, "PROSE", "Two", "g h i j k l m n o"), (1, 5, "TABLE", "Two", "head\nr1 x y\nr2 x y\nr3"), (1, 6, "PROSE", "Two", "p"), (2, 0, "TABLE", "", "lone")]
    found = spark.createDataFrame(rows, "doc bigint, block int, kind string, section string, text string")
    got = [(r.doc, r.chunk, r.kind, r.section, r.text) for r in pages.chunks(found, "doc", 4).orderBy("doc", "chunk").collect()]
    assert got == [
        (1, 0, "PROSE", "One", "a b c d"), (1, 1, "PROSE", "One", "e f"), (1, 2, "PROSE", "Two", "g h i j"), (1, 3, "PROSE", "Two", "k l m n"), (1, 4, "PROSE", "Two", "o"), (1, 5, "TABLE", "Two", "head\nr1 x y"), (1, 6, "TABLE", "Two", "head\nr2 x y\nr3"), (1, 7, "PROSE", "Two", "p"), (2, 0, "TABLE", "", "lone"),
    ]


def test_packets_are_filled_greedily(spark):
    import random

    rng = random.Random(4)
    rows = [(g, i, rng.choice([0, 1, 5, 9, 30])) for g in range(20) for i in range(rng.randrange(1, 30))]
    got = {(r.g, r.i): r.packet for r in pages.packed(spark.createDataFrame(rows, "g int, i int, n int"), ["g"], ["i"], "n", 20, 5).collect()}
    for g in range(20):
        packet, held, items = 0, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == g):
            if items and (held + n > 20 or items == 5):
                packet, held, items = packet + 1, 0, 0
            held, items = held + n, items + 1
            assert got[g, i] == packet


@pytest.mark.parametrize("forward", [True, False])
def test_asof_frames_only_grow(spark, forward):
    """A frame up to the last row is counted anew for each row: quadratic in the quotes of an hour."""
    from tidemark.operators.asof import asof

    probes = spark.createDataFrame([(i, "s", 10 * i) for i in range(50)], "id bigint, symbol string, at bigint")
    quotes = spark.createDataFrame([("s", 7 * i, float(i)) for i in range(60)], "symbol string, us bigint, bid double")
    found = asof(probes, quotes, "symbol", "at", "us", ["bid"], 1000, forward)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    side = (lambda at: min((u for u in range(0, 420, 7) if u >= at), default=None)) if forward else (lambda at: max((u for u in range(0, 420, 7) if u <= at), default=None))
    assert {r.id: r.q_us for r in found.collect()} == {i: side(10 * i) for i in range(50)}


def test_masked_nearest_against_the_column(spark):
    """Blocks give the distances of the column, with missing values, unlike lengths, ties and few shared dimensions."""
    import random

    rng = random.Random(5)
    vector = lambda: None if rng.random() < 0.05 else [rng.choice([None, 0.0, 0.25, 1.0]) for _ in range(rng.choice([9, 12]))]
    rows = spark.createDataFrame([(i % 3, i, -(i % 4), vector()) for i in range(90)], "by int, id bigint, prefer bigint, v array<double>").repartition(4)
    asked = rows.where("id % 5 = 0").select("by", "id", "v")
    got = similarity.masked_nearest(rows, asked, 4, 3, lambda i: 1.0 + i % 3, apart=True)
    pairs = rows.join(asked.select("by", F.col("id").alias("query_id"), F.col("v").alias("q")), "by").where("id <> query_id")
    pairs = pairs.withColumn("d", similarity.masked_distance("q", "v", 3, "transform(q, (x, i) -> 1D + i % 3)")).where("d is not null").withColumn("distance", F.round("d", 6))
    want = similarity.top_k(pairs, ["query_id"], [F.col("distance"), F.col("prefer"), F.col("id")], 4)
    columns = ["query_id", "id", "prefer", "d", "distance", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_experiences_of_one_vector_are_compared_once(spark):
    """The k nearest experiences of few vectors, ties by the later one, as if each were compared by itself."""
    from tidemark.operators import experience

    vectors = spark.createDataFrame([(i, [float(i // 2)] * 8) for i in range(6)], "vec_id bigint, v array<double>")
    accepted = [(i, i * 37 % 11, i % 6) for i in range(60)]
    found = experience.similar(spark.createDataFrame(accepted, "experience_id bigint, at_us bigint, vec_id bigint"), vectors, spark.createDataFrame([(1, [0.4] * 8), (2, [2.0] * 8)], "query_id bigint, v array<double>"), 7)
    got = {(r.query_id, r.rank): (r.experience_id, r.distance) for r in found.collect()}
    for query, q in ((1, 0.4), (2, 2.0)):
        order = sorted(accepted, key=lambda e: (round(abs(e[2] // 2 - q), 6), -e[1], e[0]))[:7]
        assert [got[query, i + 1] for i in range(7)] == [(e[0], round(abs(e[2] // 2 - q), 6)) for e in order]


def test_replay_holds_no_segment(spark):
    """Segments are read as a stream: no group in pandas, the same trades as the machine run over each segment."""
    ticks = [(s, 60 * i + (10_000_000 if i >= 700 else 0), 100.0 + (i * 7 * (s + 1)) % 23, 100.5 + (i * 7 * (s + 1)) % 23) for s in range(3) for i in range(1500)]
    policies = [replay.Policy("base"), replay.Policy("tight", stop=5.0, target=6.0)]
    found = replay.replay(spark.createDataFrame(ticks, "symbol bigint, us bigint, bid double, ask double").repartition(5), policies, 1_000_000)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for policy in policies:
        for symbol in range(3):
            own = [t for t in ticks if t[0] == symbol]
            for segment, part in enumerate((own[:700], own[700:])):
                machine = replay.Machine(policy)
                want += [(policy.name, symbol, segment, t["entry_us"], t["exit_us"], t["pnl"], t["exit_reason"]) for i, (_, us, bid, ask) in enumerate(part) if (t := machine.step(us, bid, ask, i == len(part) - 1))]
    assert sorted((r.candidate, r.symbol, r.segment, r.entry_us, r.exit_us, r.pnl, r.exit_reason) for r in found.collect()) == sorted(want)
