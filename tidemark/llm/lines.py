"""Line dedup by levelled sorted runs of line hashes.

A *run* is a table of line keys (128 bits of a cryptographic hash) and the number of documents that
have each, bucketed and sorted by the key. A new batch of documents is reduced to such counts; those of
keys that a run already knows to be frequent are left out by a merge anti-join, and the rest becomes a
run of its own at level 0. Two runs of a level are merged into one of the next, so after b batches at
most log2(b) + 1 runs exist and each key was rewritten as often. All runs share one bucketing, so
anti-joins and merges read the runs where they are: only a batch's own counts are shuffled, combined
before. With a threshold of one, runs are sets of seen lines, and what a batch adds is what is new in it.

Texts are read twice: once for keys, once to drop lines. A key is sent once for each slab that has it,
whatever its copies there. Frequent keys go to all executors if they take few bytes; beyond that, slabs
meet only the frequent keys they have.

Edge cases: a null or empty text is one empty line; lines of white space have an empty key and are
never frequent; rows are documents, so repeated rows (and rows of a null doc_id) count each; a very
long text is a slab by itself, a very long line is hashed whole; there are no ties; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.llm.decontaminate import ramp
from tidemark.session import Scratch, cut, prepare, table

LEAST_DOCS, LEAST_CHARS, BATCHES = 10, 1, 4
#: Frequent keys (16 bytes each) that are sent to every executor, in bytes; and bytes of a slab beyond.
BROADCAST_BYTES, SLAB_BYTES, TASK_BYTES = 8 << 20, 2 << 20, 64 << 20
STRIPPED = ~kit.SPACED
KEY = np.dtype([("h1", "<i8"), ("h2", "<i8")])


class Lines:
    """Lines of a slab: byte spans without the newline, row, and the hash of each key."""

    def __init__(self, column: pa.Array, least_chars: int) -> None:
        self.buf, offsets = kit.raw(column)
        newline = np.flatnonzero(self.buf == 10)
        self.start = np.sort(np.concatenate([offsets[:-1], newline + 1]))
        self.end = np.sort(np.concatenate([newline, offsets[1:]]))
        first = np.searchsorted(newline, offsets)
        self.count = np.diff(first) + 1
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        solid = np.flatnonzero(~STRIPPED[self.buf])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        full = np.flatnonzero(a < b)
        begin, stop = solid[a[full]], solid[b[full] - 1] + 1
        if least_chars > 1:
            chars = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
            enough = chars[stop] - chars[begin] >= least_chars
            full, begin, stop = full[enough], begin[enough], stop[enough]
        folded = kit.FOLD[self.buf].tobytes()
        hashed = b"".join(hashlib.blake2b(folded[s:e], digest_size=16).digest() for s, e in zip(begin.tolist(), stop.tolist(), strict=True))
        #: Lines that have a key, and the keys.
        self.keyed, self.key = full, np.frombuffer(hashed, dtype=KEY)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and how many rows have each."""
        order = np.lexsort((self.row[self.keyed], self.key["h2"], self.key["h1"]))
        key, row = self.key[order], self.row[self.keyed][order]
        other = np.ones(len(key), dtype=bool)
        other[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(other)
        again = np.zeros(len(key), dtype=np.int64)
        again[1:] = (row[1:] != row[:-1]) | other[1:]
        again[:1] = 1
        return key[begin], np.add.reduceat(again, begin) if len(begin) else begin


def keys(docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = 1) -> DataFrame:
    """(batch, h1, h2, n): keys of slabs, and how many of the rows there have each.

    A batch is every ``batches``-th partition of what is read.
    """

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in kit.slabs(batch):
                key, n = Lines(part.column("text"), least_chars).documents()
                which = part.column("batch")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), which), pa.int32()), pa.array(key["h1"]), pa.array(key["h2"]), pa.array(n, pa.int64())], names=["batch", "h1", "h2", "n"])

    which = (F.spark_partition_id() % batches).cast("int").alias("batch")
    return docs.select(which, "text").mapInArrow(each, "batch int, h1 bigint, h2 bigint, n bigint")


class Runs:
    """Levelled sorted runs of counted keys, in a folder that all executors share; dropped when the block ends."""

    def __init__(self, spark: SparkSession, threshold: int = LEAST_DOCS) -> None:
        self.spark, self.threshold, self.levels = spark, threshold, []
        self.scratch, self.name, self.made = Scratch(spark), f"line_runs_{uuid.uuid4().hex}", []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Runs:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.__exit__()

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"{self.name}_{len(self.made)}"
        rows.select("h1", "h2", "n").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.scratch.top}/{name}").saveAsTable(name)
        self.made.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """A batch's keys that no run knows to be frequent; one row for each."""
        left = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        for run in self.runs():
            left = left.join(run.where(F.col("n") >= self.threshold).hint("merge"), ["h1", "h2"], "left_anti")
        return left

    def add(self, counts: DataFrame) -> None:
        """Take (h1, h2, n) of a batch; full levels are compacted."""
        run, level = self._run(self.unsettled(counts)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < 2:
                return
            run, self.levels[level] = self._run(self.merged(*self.levels[level])), []
            level += 1

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """The keys of both with the sums of their counts; buckets meet where they are."""
        both = a.alias("a").join(b.alias("b").hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        return both.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that reach the threshold over all runs."""
        runs = self.runs()
        if len(runs) == 1:
            return runs[0].where(F.col("n") >= self.threshold).select("h1", "h2")
        rows = self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint")
        for run in runs:
            rows = rows.unionByName(run)
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.threshold).select("h1", "h2")


def frequent_keys(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """Keys that at least ``least_docs`` documents have, counted batch by batch."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch, Runs(spark, least_docs) as runs:
        found = scratch.written(keys(docs, least_chars, batches), "batch")
        for batch in range(batches):
            runs.add(found.where(F.col("batch") == batch))
        return cut(runs.frequent())


def kept(part: pa.RecordBatch, known: np.ndarray, least_chars: int) -> pa.RecordBatch:
    """The rows of a slab without lines whose keys are ``known`` (sorted)."""
    lines = Lines(part.column("text"), least_chars)
    gone = np.zeros(len(lines.start), dtype=bool)
    if len(known) and len(lines.key):
        distinct, place = np.unique(lines.key, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        gone[lines.keyed] = (known[at] == distinct)[place]
    stay = np.flatnonzero(~gone)
    row, size = lines.row[stay], lines.end[stay] - lines.start[stay]
    more = np.zeros(len(stay), dtype=np.int64)
    more[:-1] = row[1:] == row[:-1]
    full = size + more
    step = ramp(full)
    text = np.full(len(step), 10, dtype=np.uint8)
    inside = step < np.repeat(size, full)
    text[inside] = lines.buf[(np.repeat(lines.start[stay], full) + step)[inside]]
    n = part.num_rows
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=full, minlength=n).astype(np.int64))])
    dropped = lines.count - np.bincount(row, minlength=n)
    columns = [part.column("doc_id"), pa.array(lines.count, pa.int64()), pa.array(dropped, pa.int64()), kit.binaries(text, bounds).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "text"])


KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and text, the kept lines joined by newlines."""
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    frequent = frequent_keys(docs, least_docs, least_chars, batches)
    if frequent.count() * KEY.itemsize > broadcast_bytes:
        return _beyond(docs, frequent, least_chars)
    found = frequent.toArrow()
    known = np.empty(found.num_rows, dtype=KEY)
    for name in KEY.names:
        known[name] = found.column(name).to_numpy()
    sent = spark.sparkContext.broadcast(np.sort(known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                yield kept(part, sent.value, least_chars)

    return docs.mapInArrow(each, KEPT)


def _beyond(docs: DataFrame, frequent: DataFrame, least_chars: int) -> DataFrame:
    """The way beyond the broadcast bound: texts are dealt by slab, and keys of a slab that are frequent come back to it."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slabs, tasks = max(least, size // SLAB_BYTES), max(least, size // TASK_BYTES)
    row = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())  # repeated rows are dealt apart
    dealt = cut(docs.select(F.pmod(row, F.lit(slabs)).alias("slab"), "doc_id", "text").repartition(tasks, "slab"))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                lines = Lines(part.column("text"), least_chars)
                slab = part.column("slab").to_numpy()[lines.row[lines.keyed]]
                both = np.empty(len(slab), dtype=[("slab", "<i8"), *KEY.descr])
                both["slab"], both["h1"], both["h2"] = slab, lines.key["h1"], lines.key["h2"]
                both = np.unique(both)
                yield pa.RecordBatch.from_arrays([pa.array(both[x]) for x in both.dtype.names], names=list(both.dtype.names))

    met = dealt.select("slab", "text").mapInArrow(keys_of, "slab bigint, h1 bigint, h2 bigint").join(frequent, ["h1", "h2"]).select("slab", "h1", "h2").distinct()
    return dealt.groupBy("slab").cogroup(met.groupBy("slab")).applyInArrow(_met(least_chars), KEPT)


def _met(least_chars: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, met: pa.Table) -> pa.Table:
        known = np.empty(met.num_rows, dtype=KEY)
        for name in KEY.names:
            known[name] = met.column(name).to_numpy()
        known = np.sort(known)
        parts = [kept(part, known, least_chars) for batch in rows.combine_chunks().to_batches() for part in kit.slabs(batch)]
        return pa.Table.from_batches(parts, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())]))

    return run


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup(table(spark, sf_dir, "documents")))
