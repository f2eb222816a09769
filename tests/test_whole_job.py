"""Operators that once did less than their whole job, against brute force over small inputs."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidemark import catalog
from tidemark.plans.registry import projection
from tidemark.session import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def nearest(spark, sf):
    """{(query_id, doc_id): (score, rank)} of the ten best for every fiftieth vector, and labels."""
    rows = table(spark, sf, "embeddings").collect()
    ids, e = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    best = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            order = sorted((-round(float(x), 6), d) for d, x in zip(ids, e @ e[i], strict=True) if d != q)[:10]
            best |= {(q, d): (-x, k) for k, (x, d) in enumerate(order, 1)}
    return best, {r.vec_id: r.label for r in rows}


def test_dense_search_asks_every_fiftieth_vector(spark, sf):
    best, label = nearest(spark, sf)
    assert max(q for q, _ in best) >= 40
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in catalog.QUERIES["cosine_topk"](spark, sf).collect()}
    assert got.keys() == best.keys() and all(abs(got[k][0] - best[k][0]) < 2e-6 and got[k][1] == best[k][1] for k in best)
    asked = {r.query_id for r in catalog.QUERIES["rrf_full_outer"](spark, sf).where("semantic is not null").collect()}
    assert asked == {q for q, _ in best}
    reranked = {r.query_id for r in catalog.QUERIES["rerank_features"](spark, sf).collect()}
    docs = {r.doc_id for r in table(spark, sf, "documents").collect()}
    items = {r.item_id for r in table(spark, sf, "benchmark").collect()}
    assert {q for q, d in best if d in docs and q in items} <= reranked
    (found,) = catalog.QUERIES["recall_mrr"](spark, sf).collect()
    queries = {q for q, _ in best}
    assert found.n == len(queries)
    assert abs(found.precision_at_10 - sum(label[q] == label[d] for q, d in best) / 10 / len(queries)) < 1e-6


def split(text):
    return [w for w in re.split(r"[\s.,!?|]+", (text or "").lower()) if w]


def lexical(docs, items):
    """{(query_id, doc_id): (score, rank)} of the ten best documents with all tokens of an item."""
    words = {d: split(t) for d, t in docs}
    counts, mean = {d: Counter(w) for d, w in words.items()}, sum(map(len, words.values())) / len(words)
    df, best = Counter(w for c in counts.values() for w in c), {}
    for q, text in items:
        terms, scored = set(split(text)), []
        for d, c in counts.items():
            if terms and terms <= c.keys():
                parts = [math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[d]) / mean)) for t in terms]
                scored.append((-round(sum(parts), 6), d))
        best |= {(q, d): (-x, k) for k, (x, d) in enumerate(sorted(scored)[:10], 1)}
    return best


def test_lexical_search_takes_whole_items(spark, tmp_path, sf):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(60)), "en", f"s{i % 2}", 0) for i in range(40)]
    items = [(q, " ".join(rng.choice(vocab) for _ in range(n))) for q, n in enumerate([1, 2, 3, 4, 5, 6, 8] * 3)] + [(90, "v1 v2 nowhere"), (91, "... !"), (92, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, sf, "embeddings").write.parquet(f"{tmp_path}/embeddings.parquet")
    best = lexical([d[:2] for d in docs], items)
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in catalog.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert got.keys() == best.keys() and all(abs(got[k][0] - best[k][0]) < 2e-6 and got[k][1] == best[k][1] for k in best)
    fused = {(r.query_id, r.doc_id): r for r in catalog.QUERIES["rrf_full_outer"](spark, str(tmp_path)).collect()}
    assert {k for k, r in fused.items() if r.lexical is not None} == best.keys()
    words, first = {d[0]: set(split(d[1])) for d in docs}, {}
    rows = sorted(fused.values(), key=lambda r: (-r.fused, -(r.semantic if r.semantic is not None else -9), r.doc_id))
    for r in rows:
        if r.doc_id in words:
            first.setdefault((r.query_id, r.doc_id % 2), r.doc_id)
    reranked = {(r.query_id, r.doc_id): r.rerank for r in catalog.QUERIES["rerank_features"](spark, str(tmp_path)).collect()}
    terms = {q: set(split(t)) for q, t in items}
    for (q, d), x in reranked.items():
        phrase = dict(items)[q].lower() in docs[d][1].lower()  # all documents are "en", and no term is a source's name
        want = fused[q, d].fused + 0.35 * len(terms[q] & words[d]) / len(terms[q]) + 0.35 * phrase + 0.1 + 0.05 * (first[q, d % 2] == d)
        assert abs(x - want) < 2e-9
    assert best.keys() <= reranked.keys()


def test_offsets_hold_for_all_decisions(spark, sf):
    least, shifts = {}, set()
    for r in table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        least[r.l_orderkey] = min(least.get(r.l_orderkey, r.l_quantity), r.l_quantity)
        shifts.add(r.l_linenumber)
    want = {h: (len(least), (valid := sum(x >= h for x in least.values())), valid == len(least)) for h in shifts}
    got = {r["shift"]: (r.n, r.valid, r.holds_for_all) for r in catalog.QUERIES["relational_division"](spark, sf).collect()}
    assert max(least) >= 200 and got == want


def test_lessons_of_every_agent(spark, sf):
    rows = projection(spark, sf, "runs").collect()
    known = sorted((r for r in rows if r.us <= 852076800000000), key=lambda r: (-r.us, -r.decision_id))
    want = set()
    for a in {r.agent for r in rows}:
        want |= {(a, r.decision_id, k, "same") for k, r in enumerate([r for r in known if r.agent == a][:5], 1)}
        want |= {(a, r.decision_id, k, "cross") for k, r in enumerate([r for r in known if r.agent != a][:3], 1)}
    got = [tuple(r) for r in catalog.QUERIES["last_lessons"](spark, sf).select("agent", "decision_id", "place", "kind").collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(a for a, *_ in want) > 20


def test_six_variants_of_every_part(spark, sf):
    factors = {"tighter_stop": (0.8, 1), "wider_stop": (1.2, 1), "nearer_target": (1, 0.8), "further_target": (1, 1.2), "both_tight": (0.8, 0.8), "both_wide": (1.2, 1.2)}
    want = {(r.p_partkey, n): (float(r.p_retailprice) * a, float(r.p_retailprice) * b) for r in table(spark, sf, "part").collect() for n, (a, b) in factors.items()}
    rows = catalog.QUERIES["candidate_variants"](spark, sf).collect()
    got = {(r.p_partkey, r.name): (float(r.stop), float(r.target)) for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(abs(x - y) < 1e-4 for k in want for x, y in zip(got[k], want[k], strict=True))
