"""Grounding: the first reason of each candidate, and contradictions against comparing all pairs."""

import random
import re

import pytest

from tidemark.operators import grounding

rng = random.Random(9)
BLOCKS = "candidate bigint, ref string, text string, fields map<string,string>"
CANDIDATES = "candidate bigint, refs array<struct<ref:string,fields:map<string,string>>>"


def verdict(spark, refs, claims, blocks):
    rows = [(1, [(r, None) if isinstance(r, str) else r for r in refs])]
    said = [(1, i, t, None if rs is None else [(r, None) if isinstance(r, str) else r for r in rs]) for i, (t, rs) in enumerate(claims)]
    frames = (spark.createDataFrame(x, k) for x, k in ((rows, CANDIDATES), (said, grounding.CLAIMS), ([(1, *b) for b in blocks], BLOCKS)))
    r = grounding.grounded(*frames).first()
    return r.accepted, r.reason, r.i, r.j


def test_first_reason(spark):
    full = {"document_id": "d", "page": "3"}
    blocks = [("a", "Momentum rises after the range breaks", full), ("b", "spread is wide", None)]
    good = ("momentum of the range", ["a"])
    check = lambda refs, claims, blocks=blocks: verdict(spark, refs, claims, blocks)
    assert check(["a"], [good]) == (True, None, None, None)
    assert check([], [good]) == (False, "GROUNDING_FAILED", None, None) and check(["a"], []) == (False, "GROUNDING_FAILED", None, None)
    assert check(["zz"], [good]) == (False, "GROUNDING_FAILED", None, None)
    assert check([("a", {"document_id": "d"})], [good]) == (False, "SOURCE_PROVENANCE_INCOMPLETE", None, None)
    assert check([("a", {"document_id": "d", "page": "4"})], [good])[1] == "SOURCE_PROVENANCE_INCOMPLETE" and check([("a", full)], [good])[0]
    assert check(["a"], [good, ("momentum of the range", [])]) == (False, "GROUNDING_FAILED", 1, None)
    assert check(["a"], [good, ("momentum range", None)]) == (False, "GROUNDING_FAILED", 1, None)
    assert check(["a"], [good, ("momentum range", ["b", "zz"])]) == (False, "GROUNDING_FAILED", 1, None)
    assert check(["a"], [good, ("  ", ["a"])]) == (False, "UNSUPPORTED_CLAIM", 1, None)
    assert check(["a"], [("spread narrows", ["a"]), good]) == (False, "UNSUPPORTED_CLAIM", 0, None)
    assert check(["a"], [("this claim has no words of it", ["a"])])[0]  # words about claims pass
    assert check(["a"], [("spread is wide", ["a", "b"])])[0]  # one of its references is enough
    assert check(["a"], [("anything at all", ["x"])], [("x", "", None), ("a", None, None)])[0]  # no text to hold it against
    assert check(["a"], [("momentum of range", ["a"]), ("not momentum of range", ["a"])]) == (False, "CONTRADICTION", 0, 1)
    assert check(["a"], [("momentum range higher", ["a"]), ("range breaks", ["a"]), ("momentum range lower", ["a"])]) == (False, "CONTRADICTION", 0, 2)


def contradicts(a, b):
    w = [set(re.findall("[a-z0-9]+", x.lower())) - set(grounding.STOP) for x in (a, b)]
    neg = [bool(x & set(grounding.NEGATIONS)) for x in w]
    w = [x - set(grounding.NEGATIONS) for x in w]
    shared = len(w[0] & w[1])
    if neg[0] != neg[1] and shared >= 2 and shared / max(1, min(map(len, w))) >= 0.7:
        return True
    return shared >= 1 and any(w[0] & set(p) and w[1] & set(q) or w[0] & set(q) and w[1] & set(p) for p, q in grounding.OPPOSITES)


@pytest.mark.parametrize("seed", [1, 2])
def test_contradictions_against_all_pairs(spark, seed):
    r = random.Random(seed)
    vocabulary = ["risk", "spread", "trend", "range", "not", "never", "higher", "lower", "more", "available", "missing", "the", "of"]
    rows = [(c, i, " ".join(r.choices(vocabulary, k=r.randrange(0, 7)))) for c in range(12) for i in range(12)]
    want = {(c, i, j) for c, i, a in rows for d, j, b in rows if c == d and i < j and a.strip() and b.strip() and contradicts(a, b)}
    found = grounding.contradictions(spark.createDataFrame(rows, "candidate bigint, i int, text string").repartition(3))
    assert {tuple(x) for x in found.collect()} == want and want


def test_nothing_to_ground(spark):
    frames = [spark.createDataFrame([], k) for k in (CANDIDATES, grounding.CLAIMS, BLOCKS)]
    assert grounding.grounded(*frames).collect() == []
