"""The inverted and the vector index against brute force: same hits, few blocks, measured recall, generations."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings, similarity, vectors
from tidemark.session import table

rng = random.Random(17)
VOCAB = [f"w{i}" for i in range(60)] + ["Café", "café", "STRASSE", "straße", "a_b", "x-y", "日本", "İ"]


def tokens(text):
    text = unicodedata.normalize("NFC", text or "").casefold()
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    return re.findall(r"(?:[^\W]|-)+", text)


def brute(docs, queries, k):
    split = {d: tokens(t) for d, t in docs.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split) or 1.0
    df = Counter(w for t in split.values() for w in set(t))
    out = []
    for q, text in queries:
        terms = set(tokens(text))
        if not terms:
            continue
        hits = []
        for d, t in split.items():
            tf = Counter(t)
            if all(tf[w] for w in terms):
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in terms)
                hits.append((-round(score, 6), d))
        out += [(q, d, pytest.approx(-s, abs=2e-6), i + 1) for i, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=lambda r: (r[0], r[3]))


def corpus(n, start=0):
    return {start + i * 3: " ".join(rng.choices(VOCAB, weights=[1 / (j + 1) for j in range(len(VOCAB))], k=rng.randrange(0, 60))) for i in range(n)}


QUERIES = [(1, "w0"), (2, "w1 W0"), (3, "cafe"), (4, "Straße w0"), (5, "w3 w5 w7"), (6, "none of these"), (7, ""), (8, None), (9, "x-y"), (10, "日本 w0"), (11, "w0 w0 w0")]


def found(hits):
    return sorted((tuple(r) for r in hits.select("query_id", "doc_id", "score", "rank").collect()), key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("block,parts,named", [(8, 4, 1000), (50, 1, 0), (4096, 256, 1000)])
def test_postings_against_brute_force(spark, tmp_path, monkeypatch, block, parts, named):
    monkeypatch.setattr(postings, "NAMED", named)
    docs = corpus(150)
    docs[901], docs[902] = None, "   "
    rows = spark.createDataFrame(list(docs.items()) + [(None, "w0")], "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id bigint, text string")
    postings.build(rows, str(tmp_path), "g1", block, parts)
    hits, counts = postings.search(postings.opened(spark, str(tmp_path)), queries, 5, first=1)
    assert found(hits) == brute(docs, QUERIES, 5)
    r = counts.first()
    assert r.scored <= r.ranges


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, tmp_path):
    """Short documents with the word often are far better; ranges of long ones are bounded below them."""
    docs = {i: ("hot " * 5 if i < 20 else "hot " + " ".join(f"f{j}" for j in range(80))) for i in range(400)}
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    postings.build(rows, str(tmp_path), "g1", block=10, parts=8)
    hits, counts = postings.search(postings.opened(spark, str(tmp_path)), spark.createDataFrame([(1, "hot")], "query_id bigint, text string"), 5, first=2)
    assert found(hits) == brute(docs, [(1, "hot")], 5)
    r = counts.first()
    assert (r.blocks, r.ranges, r.scored) == (40, 40, 2) and postings.skipped(counts) == 0.95


def test_only_the_terms_of_queries_are_read(spark, tmp_path):
    rows = spark.createDataFrame(list(corpus(50).items()), "doc_id bigint, text string")
    postings.build(rows, str(tmp_path), "g1")
    index = postings.opened(spark, str(tmp_path))
    plan = index.postings().where(F.col("term").isin(["w1", "w2"])).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w1,w2])" in plan and "docs" not in plan.split("ReadSchema")[1]


def test_generations_of_postings(spark, tmp_path):
    root, docs = str(tmp_path), corpus(120)
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id bigint, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, text string")
    postings.build(frame(docs), root, "g1", block=10, parts=3)
    changed = {3: "w0 w0 w0 cafe", 1000: "w0 straße", 9: ""}
    removed = [6, 12, 77777]
    touched = postings.update(frame(changed), spark.createDataFrame([(i,) for i in removed], "doc_id bigint"), root, "g2")
    docs = {d: t for d, t in {**docs, **changed}.items() if d not in removed}
    index = postings.opened(spark, root)
    assert touched == 3 and {g for _, g in index.places} == {"g1", "g2"}
    assert found(postings.search(index, queries, 7)[0]) == brute(docs, QUERIES, 7)
    assert postings.update(frame({}), spark.createDataFrame([], "doc_id bigint"), root, "g3") == 0
    assert found(postings.search(postings.opened(spark, root), queries, 7)[0]) == brute(docs, QUERIES, 7)


def test_postings_of_nothing(spark, tmp_path):
    postings.build(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path), "g1")
    hits, _ = postings.search(postings.opened(spark, str(tmp_path)), spark.createDataFrame(QUERIES, "query_id bigint, text string"), 5)
    assert hits.count() == 0


def test_recall_of_the_vector_index(spark, tmp_path):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 50 = 0")
    index = vectors.build(rows, str(tmp_path / "v"), rows.select(F.size("v")).first()[0])
    true = {(r.query_id, r.doc_id) for r in similarity.nearest(rows, asked, 10).collect()}
    got = {(r.query_id, r.doc_id) for r in vectors.search(index, asked, 10).collect()}
    recall = len(true & got) / len(true)
    print("recall", recall, "probes", index.probes, "of", len(index.centroids))
    assert recall >= 0.9
    assert spark.read.parquet(str(tmp_path / "v")).count() == rows.count()


@pytest.mark.parametrize("shape", ["clusters", "one point", "line"])
def test_exact_search_by_bounds(spark, tmp_path, shape):
    r = np.random.default_rng(3)
    if shape == "clusters":
        data = (r.normal(size=(12, 6))[r.integers(0, 12, 400)] * 5 + r.normal(size=(400, 6))).tolist()
    elif shape == "one point":
        data = [[1.0, 2.0, 0.0, 0.0, 0.0, 0.0]] * 300 + r.normal(size=(40, 6)).tolist() + [[0.0] * 6] * 5
    else:
        data = [[1.0, i / 50, 0.0, 0.0, 0.0, 0.0] for i in range(200)]
    rows = spark.createDataFrame([*enumerate(data), (7777, None), (None, data[0]), (7778, [1.0])], "id bigint, v array<double>").repartition(3)
    asked = rows.where("id % 17 = 0")
    index = vectors.build(rows, str(tmp_path / "v"), 6, k=5, cells=12)
    whole = rows.where("id is null or id < 7000")
    want = sorted((x.query_id, x.rank, x.doc_id, x.score) for x in similarity.nearest(whole, asked, 5).collect())
    assert sorted((x.query_id, x.rank, x.doc_id, x.score) for x in vectors.search(index, asked, 5, probes=1, exact=True).collect()) == want
    few = vectors.search(index, asked, 5, probes=12).collect()
    assert sorted((x.query_id, x.rank, x.doc_id, x.score) for x in few) == want


def test_vectors_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    index = vectors.build(none, str(tmp_path / "v"), 4)
    assert vectors.search(index, none, 3).collect() == [] and vectors.search(index, none, 3, exact=True).collect() == []
