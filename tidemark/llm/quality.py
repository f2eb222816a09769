"""Quality classifier by positive-unlabelled learning.

Features of a whole text (shares of character classes, word shapes, repetition, hashed character
bigrams) feed a linear model. It minimises the non-negative unbiased risk: trusted positives give
the positive part and, weighted by the class prior, what is taken off the risk of unlabelled web
text, which is never let below zero. The prior is estimated from the same two samples: a model that
tells positives from unlabelled texts is fitted on one half of each, and on the other half the least
ratio of the share of unlabelled texts above a score to the share of positives above it bounds the
share of positives among unlabelled texts; no negative label is used. Positives and unlabelled texts
are bounded samples (``FIT_POSITIVE``, ``FIT_UNLABELLED`` rows, those first by a hash of doc_id) of
the rows that may be learnt from; scoring covers whole texts of all rows.

Edge cases: null texts count as empty and are scored like empty ones; without any positive or
unlabelled row the prior is one half and scores say only how a text compares; repeated rows are
scored alike and each is returned; repeated labels of a document count once, the greatest quality
winning; equal scores are equal, no order is given; a very long text is a slab by itself; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.llm.language import fold
from tidemark.session import prepare, table

FIT_POSITIVE, FIT_UNLABELLED = 5000, 10000
BIGRAMS = 128
STEPS, RATE, DECAY = 700, 0.05, 1e-4

#: Character classes by byte: lower and upper case ASCII, digits, blanks, line ends, marks of
#: sentences, other marks, bytes of other characters.
KIND = np.full(256, 7, dtype=np.uint8)
KIND[:128] = 6
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
KIND[[32, 9]], KIND[[10, 13]] = 3, 4
KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
N_KINDS = 8


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text of a slab."""
    words = kit.Words(column, kit.SPACED, lower=True)
    buf, offsets, rows = words.buf, words.offsets, len(words.count)
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    share = np.bincount(row * N_KINDS + KIND[buf], minlength=rows * N_KINDS).reshape(rows, N_KINDS)
    pairs = (buf[:-1].astype(np.int64) * 263 + buf[1:] * 71) % BIGRAMS
    pairs = np.bincount(row[:-1] * BIGRAMS + pairs, minlength=rows * BIGRAMS)[: rows * BIGRAMS].reshape(rows, BIGRAMS) if len(buf) else np.zeros((rows, BIGRAMS))
    length, n = words.end - words.start, words.count
    of = words.row()
    by = lambda w: np.bincount(of, weights=w, minlength=rows)
    some = np.maximum(n, 1)
    mean = by(length) / some
    spread = np.sqrt(np.maximum(by(length.astype(float) ** 2) / some - mean**2, 0))
    order = np.lexsort((words.hash, of))
    h, r = words.hash[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(r[new], minlength=rows)
    begin = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, r[begin], np.diff(np.append(begin, len(h))))
    same = np.zeros(len(of), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    last = KIND[buf[words.end - 1]] if len(of) else np.zeros(0, np.uint8)
    first = KIND[buf[words.start]] if len(of) else np.zeros(0, np.uint8)
    total = np.maximum(size, 1)[:, None]
    shapes = [
        np.log1p(n), np.log1p(n) ** 2 / 10, n == 0, n < 5, n < 20, mean, spread, distinct / some, np.log1p(distinct) - np.log1p(n), most / some, most / some > 0.3, by(same) / some,
        by(last == 6) / some, by(last == 5) / some, by(first == 1) / some, by(first == 6) / some, by(length > 20) / some, by(length == 1) / some, share[:, 1] / np.maximum(share[:, 0] + share[:, 1], 1), share[:, 4] / some,
    ]
    return np.concatenate([np.stack([np.asarray(x, dtype=np.float64) for x in shapes], axis=1), share / total, np.sqrt(share / total), np.sqrt(pairs / total)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        x = np.clip((features(column) - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss by Adam."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = np.append(np.zeros(p.shape[1]), np.log(prior / (1 - prior)))
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32) for x in (p, u))
    w = w.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        fp, fu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad_positive = prior * (p * (sp - 1)[:, None]).mean(axis=0)
        grad_negative = (u * su[:, None]).mean(axis=0) - prior * (p * sp[:, None]).mean(axis=0)
        grad = grad_positive + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, by the best bin of held-out scores.

    Of all thresholds the one is taken whose upper confidence bound of the ratio is least.
    """
    if len(positive) < 8 or len(unlabelled) < 8:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5)
    at = lambda x: np.sort(np.clip((x - model.mean) / model.scale, -6, 6) @ model.weight)
    p, u = at(positive[1::2]), at(unlabelled[1::2])
    cuts = np.unique(p)
    above_p, above_u = ((len(x) - np.searchsorted(x, cuts)) / len(x) for x in (p, u))
    slack = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(min(0.97, max(0.03, above_u[best] / above_p[best])))


def _sample(docs: DataFrame, rows: int) -> np.ndarray:
    """Features of a bounded sample, computed where the rows are."""
    some = kit.sample(docs, rows, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([kit.blob(x) for x in features(part.column("text"))], pa.binary())], names=["doc_id", "x"])

    found = some.mapInArrow(run, "doc_id bigint, x binary").orderBy("doc_id", "x").collect()
    width = features(pa.array([""])).shape[1]
    out = np.array([np.frombuffer(r.x) for r in found]).reshape(-1, width)
    return out[np.random.default_rng(5).permutation(len(out))]  # halves of it are as good as each other


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the rows given: their positives, their texts, and the prior that both show."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    positive, unlabelled = _sample(docs.join(good, "doc_id", "left_semi"), FIT_POSITIVE), _sample(docs, FIT_UNLABELLED)
    prior = estimated_prior(positive, unlabelled)
    if not len(unlabelled):
        unlabelled = np.zeros((1, features(pa.array([""])).shape[1]))
    return fit(positive if len(positive) else unlabelled, unlabelled, prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from the text alone."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(part.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    may = F.coalesce(fold("doc_id", 3), F.lit(0)) != 1
    found = scored(docs, learn(docs.where(may), labels.where(may)))
    held = F.coalesce(fold("doc_id", 3), F.lit(0)) == 1
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
