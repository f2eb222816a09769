"""Importance resampling towards a target distribution, in two passes of Arrow batches.

Features are all runs of 1 to ``RUN`` words, hashed into buckets by CRC-32. The first pass counts the
buckets of each partition (``np.bincount``) and yields one vector for it; ``treeReduce`` adds the
vectors up, so the driver gets one, whatever the number of partitions. A bucket's gain is its log
ratio between target and corpus. The second pass gathers the gains, which are broadcast (one number a
bucket, a fixed size), at each feature and sums them by document. With a Gumbel number drawn from a hash
of the doc_id, the highest scores are a sample without replacement by weight.

Checksums of runs go on from those of shorter ones: the state after "a" takes " b" and is that of
"a b". States of all words of a slab advance a byte at a time together.

Edge cases: null, empty and wordless texts have no feature and weight 0; a text of fewer words than the
least is scored and never drawn; a very long text is a slab by itself; ties of score go to the smaller
doc_id (a null one first, drawn by the hash of no id), repeated rows are ranked one after the other in
the order in which they were read; an empty corpus gives an empty result and an empty target counts as
one without features; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.operators.order import positioned
from tidemark.session import cut, prepare, table

RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Vectors that one task of the tree adds up, about.
FAN_IN = 64
#: Words of more bytes are checked by the library, one by one.
LONG = 64
ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


CRC = _crc_table()


def advanced(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after they took the bytes ``buf[start[i]:end[i]]``."""
    state, size = state.copy(), end - start
    at = np.flatnonzero((size > 0) & (size <= LONG))
    now, place, left = state[at], start[at], size[at]
    while len(at):
        now = CRC[(now ^ buf[place]) & 255] ^ (now >> np.uint32(8))
        left = left - 1
        done = left == 0
        if done.any():
            state[at[done]] = now[done]
            more = ~done
            at, now, place, left = at[more], now[more], place[more], left[more]
        place = place + 1
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = zlib.crc32(buf[start[i] : end[i]].tobytes(), int(state[i] ^ ONES)) ^ 0xFFFFFFFF
    return state


class Features:
    """Buckets of the features of a slab's rows, and the row of each."""

    def __init__(self, column: pa.Array, run: int, buckets: int) -> None:
        buf, offsets = kit.raw(column)
        start, end = kit.runs(kit.ALNUM[buf], offsets)
        buf = kit.FOLD[buf]
        first = np.searchsorted(start, offsets)
        self.words = np.diff(first)
        row = np.repeat(np.arange(len(self.words)), self.words)
        left = np.repeat(first[1:], self.words) - np.arange(len(start))
        state, found, of = np.full(len(start), ONES), [], []
        for n in range(run):
            some = np.flatnonzero(left > n)
            state = state[: len(start)][some] if n == 0 else state[np.searchsorted(before, some)]
            if n:
                state = CRC[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8))
            state = advanced(state, buf, start[some + n], end[some + n])
            found.append((state ^ ONES) % np.uint32(buckets))
            of.append(row[some])
            before = some
        self.bucket, self.row = np.concatenate(found).astype(np.int64), np.concatenate(of)


def counted(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in kit.slabs(batch):
                total += np.bincount(Features(part.column("text"), run, buckets).bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([kit.blob(total)], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(each, "counts binary").rdd
    partitions = vectors.getNumPartitions()
    if not partitions:
        return np.zeros(buckets, dtype=np.int64)
    depth = max(2, math.ceil(math.log(partitions, FAN_IN)))
    return vectors.map(lambda r: np.frombuffer(r.counts, dtype=np.int64)).treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share, smoothed by one feature a bucket, floored."""
    s, t = float(source.sum()), float(target.sum())
    n = len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """Per document: doc_id, n_words, n_features and weight, the sum of its features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                found, n = Features(part.column("text"), run, len(sent.value)), part.num_rows
                weight = np.bincount(found.row, weights=sent.value[found.bucket], minlength=n)  # whole numbers, exact below 2 ** 53
                columns = [found.words, np.bincount(found.row, minlength=n), weight.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int) -> Column:
    """Thousandths of a Gumbel number drawn by a hash of the doc_id, floored."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank; rows that aren't drawn have none.

    floor(percent * N / 100) of the N documents with enough words are drawn, those of the highest
    scores. Scores are ranked by ranges, so no task holds all of them.
    """
    prepare(docs.sparkSession)
    gain = gains(counted(docs, run, buckets), counted(target, run, buckets))
    scored = cut(weighed(docs, gain, run).withColumn("score", F.col("weight") + gumbel(seed)).withColumn("below", -F.col("score")).withColumn("read", F.monotonically_increasing_id()))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    place = F.col("position")
    ranked = positioned(enough, ["below", "doc_id", "read"]).withColumn("rank", F.when(place < drawn, place + 1)).drop("position")
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The documents drawn, in their columns; repeated rows of a drawn doc_id stay together."""
    ids = resampled(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
