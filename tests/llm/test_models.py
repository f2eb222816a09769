"""Learnt operators by held-out accuracy, the Viterbi scan by brute force, and the pipeline."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import language, quality
from tidemark.session import table

MID = "/root/testdata/sf0.01"


def best_total(score, penalty):
    v = score[0].copy()
    for s in score[1:]:
        v = np.maximum(v, v.max() - penalty) + s
    return v.max()


@pytest.mark.parametrize("k", [2, 4])
def test_viterbi_finds_the_best_sequence(k):
    rng = np.random.default_rng(k)
    sizes = [0, 1, 2, 63, 64, 65, 128, 129, 0, 700]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = (rng.normal(size=(first[-1], k)) * 3).astype(np.float32)
    path = language.viterbi(score, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            total = score[np.arange(a, b), path[a:b]].sum() - language.SWITCH * (path[a + 1 : b] != path[a : b - 1]).sum()
            assert np.isclose(total, best_total(score[a:b], language.SWITCH), atol=1e-2)


def test_language_held_out(spark):
    rows = language.op6_language_id(spark, MID).join(table(spark, MID, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_edges(spark):
    schema = "doc_id bigint, text string, lang string, lang_pred string"
    rows = [(1, None, "en", ""), (2, "", "de", ""), (3, "12 34 !!", None, ""), (None, "the thing of that", "en", ""), (5, "die und der schon", "de", ""), (5, "die und der schon", "de", ""), (6, "the of " * 20000, "en", "")]
    docs = spark.createDataFrame(rows, schema)
    model = language.learn(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == 7 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"de"} and all(0 <= r.score <= 1 for r in got)
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
    assert sorted(r.doc_id or 0 for r in language.confident(docs, model).collect()) == [0, 5, 5, 6]


def test_language_spans_of_mixed_text(spark):
    docs = table(spark, MID, "documents")
    model = language.learn(docs)
    part = {lang: docs.where(f"lang = '{lang}' and n_chars between 300 and 900").orderBy("doc_id").first().text for lang in ("en", "de")}
    _, score, spans = language.label(pa.array([part["en"] + " " + part["de"]]), model, True)
    assert [s["lang"] for s in spans[0]] == ["en", "de"] and score[0] < 1


def test_quality_held_out(spark):
    rows = quality.op7_quality_classifier(spark, MID).join(table(spark, MID, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "z " * 30000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    assert quality.scored(docs, model).where("score between 0 and 1").count() == 5
    assert quality.scored(docs.limit(0), model).count() == 0
    empty = quality.learn(docs.limit(0), labels.limit(0))
    assert quality.scored(docs, empty).count() == 5


def test_risk_is_non_negative_and_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (500, 4)), rng.normal(-1, 1, (500, 4))
    model = quality.fit(good[:200], np.concatenate([good[200:], bad]), 0.375)
    at = lambda x: ((x - model.mean) / model.scale) @ model.weight + model.bias
    assert (at(good) > 0).mean() > 0.85 and (at(bad) < 0).mean() > 0.85


def test_pipeline_keeps_columns_and_clean_documents(spark, sf):
    docs = table(spark, sf, "documents")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "byte_bpe":
            assert after.columns == columns
            if name != "ngram_jaccard_join":
                assert after.count() >= 0.95 * before.count()
        before = after
    assert sorted(before.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]


def test_pipeline_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the thing of that and", "en", None, None), (3, "the thing of that and", "en", "s", 21), (3, "the thing of that and", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 1
        stage(spark, docs.limit(0), sf).count()
