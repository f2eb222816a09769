"""What a query holds or moves must not grow faster than its input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame

from tidemark import catalog
from tidemark.operators import asof, corpus, postings, similarity, vectors
from tidemark.plans import carried, outcomes
from tidemark.session import cut


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_meet_as_a_stream(spark, monkeypatch):
    """Pairs of blocks once filled Arrow batches by the thousand; a stream holds a group's asked vectors only."""
    monkeypatch.setattr(similarity, "GROUP", 7)
    monkeypatch.setattr(similarity, "AT_ONCE", 3)
    rng = np.random.default_rng(5)
    e = rng.integers(-2, 3, (300, 4)).astype(float)
    e[40:160] = e[40]  # copies: ties go to the lesser id
    rows = spark.createDataFrame([(i, e[i].tolist()) for i in range(300)] + [(None, [1.0] * 4), (900, None)], "id long, v array<double>").repartition(5)
    got = similarity.nearest(rows, rows.where("id % 10 = 0"), 6)
    assert "Join" not in plan(got)
    n = np.linalg.norm(e, axis=1, keepdims=True)
    u = e / np.where(n == 0, 1, n)
    want = []
    for q in range(0, 300, 10):
        score = np.round(u @ u[q], 6) + 0.0
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:6]
        want += [(q, int(i), r + 1, float(score[i])) for r, i in enumerate(order)]
    assert sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in got.collect()) == sorted(want)


def test_bm25_counts_words_where_they_lie(spark, tmp_path):
    """Postings of all query terms were shuffled; now documents with all terms are found in one pass of the table."""
    texts = ["a b c a", "b c", "a a a", None, "", "a b", "c c c b a", "A, b. C!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, ["a", "zz"])], "query_id long, terms array<string>")
    got = corpus.bm25(docs, asked, 3)
    assert plan(got).count("Relation [doc_id") == 1
    words = {i: [w for w in re.split(r"[\s.,!?|]+", t.lower()) if w] for i, t in enumerate(texts) if t is not None}
    mean, n, want = sum(map(len, words.values())) / len(words), len(texts), []
    for q, terms in ((1, {"a", "b"}), (2, {"c"})):
        found = []
        for i, w in words.items():
            if terms <= set(w):
                df = {t: sum(t in x for x in words.values()) for t in terms}
                found.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 6), i))
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:3])]
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_bm25_of_repeated_ids(spark):
    """Rows of one id and length are one document, as the SQL groups them."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a b c"), (3, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, ["a", "c"])], "query_id long, terms array<string>")
    assert {r.doc_id for r in corpus.bm25(docs, asked, 5).collect()} == {1, 2}


def test_quantiles_read_joined_rows_once(spark, sf, monkeypatch):
    """Each pass over the values joined runs and evaluations anew."""
    rows = []
    exact = carried.quantiles.exact
    monkeypatch.setattr(carried.quantiles, "exact", lambda values, *a: rows.append(plan(values)) or exact(values, *a))
    assert catalog.QUERIES["outcomes_by_transition"](spark, sf).count() == 9
    assert "Join" not in rows[0]


def test_next_horizons_are_counted_before_they_meet(spark, monkeypatch):
    """Copies of a row met all copies of the next; now a count meets a count."""
    keys = [(1, 1), (1, 1), (1, 2), (1, 2), (1, 2), (1, 4), (2, 3), (2, 4), (None, 1), (None, 2), (3, None), (3, 1)]
    monkeypatch.setattr(outcomes, "projection", lambda *_: spark.createDataFrame(keys, "decision_id long, horizon int"))
    got = catalog.QUERIES["composite_left_join"](spark, "")
    assert "Join" not in plan(got)
    want = {(a, h, sum(a is not None and h is not None and (a, h + 1) == x for x in keys) * keys.count((a, h))) for a, h in keys}
    assert {tuple(r) for r in got.collect()} == want


def test_prefixes_are_shuffled_not_whole_sets(spark, monkeypatch):
    """All shingles were shuffled to be counted; any common order of them gives the same pairs."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 40, rng.integers(4, 90))]
        texts += [" ".join(base), " ".join(base).upper() + "!", " ".join(base[:-1]), " ".join([*base, "more"])]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(4)
    sets: dict[frozenset, int] = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\s.,!?|]+", t.lower()) if x]
        if len(w) >= 5:
            sets.setdefault(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)), i)
    named = sorted((i, s) for s, i in sets.items())
    want = {(a, b, round(len(x & y) / len(x | y), 9)) for a, x in named for b, y in named if a < b and len(x & y) / len(x | y) >= 0.9}
    stored = []
    monkeypatch.setattr(corpus, "cut", lambda df: stored.append(plan(df)) or cut(df))
    for cells in (1 << 20, 1, 64):
        monkeypatch.setattr(corpus, "CELLS", cells)
        got = corpus.shingle_pairs(docs)
        assert {(r.a, r.b, round(r.jaccard, 9)) for r in got.collect()} == want and want
    assert not any("Window" in p for p in stored)


def test_ranges_meet_blocks_not_points(spark, sf):
    """Each decision was joined with all ticks of its horizons; now a tick goes to one block, whatever ranges hold it."""
    assert not re.search("Join Inner.*>=", plan(catalog.QUERIES["outcome_evaluation"](spark, sf)))
    rng = random.Random(6)
    points = [(rng.choice(["a", "b", None]), rng.randrange(-300, 300), rng.choice([None, *range(9)])) for _ in range(400)] + [("a", 5, v) for v in (-4, 40)]
    ranges = [(rng.choice([*range(60), None]), rng.choice(["a", "b", "c", None]), rng.choice([None, 5, *range(-330, 330)]), n) for _ in range(150) for n in (8, 16, 50, 51)]
    want: dict[tuple, list] = {}
    for i, k, lo, n in ranges:
        found = want.setdefault((i, n), [])
        if k is not None and lo is not None:
            found += [v for p, t, v in points if p == k and lo <= t <= lo + n and v is not None]
    frame = spark.createDataFrame(ranges, "id int, k string, lo bigint, n bigint").repartition(3)
    got = asof.extremes(frame, spark.createDataFrame(points, "k string, us bigint, v int").repartition(4), ["id", "n"], "k", "lo", "n", (8, 16, 50, 51), "us", "v")
    assert {(r.id, r.n): (r.most, r.least) for r in got.collect()} == {x: (max(v, default=None), min(v, default=None)) for x, v in want.items()}


def test_cells_meet_queries_as_a_stream(spark, tmp_path, monkeypatch):
    """Blocks of a cell met blocks of queries in pairs, each query sixteen times whatever the cell's size."""
    monkeypatch.setattr(vectors, "PART", 20)
    monkeypatch.setattr(vectors, "GROUP", 5)
    e = np.random.default_rng(8).integers(-3, 4, (240, 5)).astype(float)
    e[30:130] = e[30]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e) if v.any()], "id long, v array<double>").repartition(3)
    index = vectors.build(rows, f"{tmp_path}/v", 5, k=4, cells=6)
    assert index.sizes.sum() == rows.count()
    asked = rows.where("id % 12 = 0")
    assert "Join" not in plan(vectors.search(index, asked, 4))
    found = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert found(vectors.search(index, asked, 4, exact=True)) == found(similarity.nearest(rows, asked, 4))


def shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_shuffled_not_words(spark, tmp_path):
    """Each word of each document was shuffled twice to build the index, and each entry of a query's terms to search it."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=60)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    began = shuffled(spark)
    postings.build(docs, str(tmp_path), "g1")
    assert shuffled(spark) - began < 1000  # 41 words of 3 tasks; 38,674 before
    asked = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8")], "query_id long, text string")
    began = shuffled(spark)
    found = {r.doc_id for r in postings.search(postings.opened(spark, str(tmp_path)), asked, 2000)[0].collect()}
    assert found == {i for i, t in enumerate(texts) if set(t.split()) >= {f"w{j}" for j in range(1, 9)}}
    assert shuffled(spark) - began < 1000


def test_postings_of_repeated_ids_and_small_pieces(spark, tmp_path, monkeypatch):
    """Rows of one id and length are one document wherever they lie, and pieces, groups and joins of any size give the same."""
    rng = random.Random(9)
    rows = [(rng.choice([-7, -1, 0, 3, 8, 9, 10, 11, 40, (1 << 60) + 1]), " ".join(rng.choices("abcdef", k=rng.choice([0, 2, 3, 12])))) for _ in range(60)] + [(i, "a b c") for i in range(100, 160)]
    tf, met, score = Counter(), Counter(), defaultdict(float)
    for i, t in rows:
        tf.update((w, i, len(t.split())) for w in t.split())
    df, n, mean = Counter(k[0] for k in tf), len(rows), sum(len(t.split()) for _, t in rows) / len(rows)
    queries = {1: "a", 2: "b a", 3: "c d e f"}
    for q, text in queries.items():
        for (w, i, dl), f in tf.items():
            if w in text.split():
                met[q, i] += 1
                score[q, i] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))
    want = {(q, i, round(score[q, i], 5)) for (q, i), m in met.items() if m == len(queries[q].split())}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for held, group, sent in ((1 << 21, 64, 200_000), (15, 1, 0)):
        for name, value in (("HELD", held), ("GROUP", group), ("SENT", sent), ("NAMED", 0)):
            monkeypatch.setattr(postings, name, value)
        postings.build(docs, f"{tmp_path}/{held}", "g1")
        index = postings.opened(spark, f"{tmp_path}/{held}")
        assert (index.n, index.total) == (n, sum(len(t.split()) for _, t in rows))
        got = postings.search(index, asked, 1000)[0].collect()
        assert {(r.query_id, r.doc_id, round(r.score, 5)) for r in got} == want and len(got) == len(want)
        entries = index.postings().select("term", "docs", "dls", "tfs").collect()
        assert Counter({(r.term, i, dl): f for r in entries for i, dl, f in zip(r.docs, r.dls, r.tfs, strict=True)}) == tf
