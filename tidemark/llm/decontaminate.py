"""Benchmark decontamination: find training words inside benchmark windows, remove spans or documents.

Every window of ten normalised benchmark words (an item of fewer words is one window) is hashed
into a sorted array. While the benchmark is within ``BROADCAST_BYTES`` (measured before anything is
collected) that array is broadcast and documents are scanned in one pass without a shuffle. Beyond
it, document windows are joined with benchmark windows by hash, and the hits go back to their rows.
Either way, each hit is verified word by word on the bytes, so a hash collision changes nothing.

Edge cases: null or wordless texts have no words and no hits; null item texts have no windows; an
empty benchmark hits nothing; repeated document rows are each reported; repeated items count once
per item_id (null item_ids are ignored); ties need no order, items being a sorted set; a very long
text is a slab by itself; columns other than those named are kept (``without_spans``) or ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import kit
from tidemark.session import cut, prepare, table

WINDOW = 10
#: Most bytes of benchmark text that are sent to every executor.
BROADCAST_BYTES = 8 << 20

SCAN = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:bigint,stop:bigint>>"


@dataclass
class Index:
    """Distinct benchmark windows, sorted by hash; window g has ``size[g]`` words from word ``at[g]``."""

    hash: np.ndarray
    size: np.ndarray
    at: np.ndarray
    owner: np.ndarray  # flat item ids, those of window g from bounds[g] on
    bounds: np.ndarray
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sieve: np.ndarray  # one byte for each 20-bit hash prefix

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h with a known hash, each with every window of that hash."""
        rough = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[rough], side="left")
        n = np.searchsorted(self.hash, h[rough], side="right") - lo
        return np.repeat(rough, n), np.repeat(lo, n) + ramp(n)


def ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def build(items: list[tuple[int, str | None]], window: int = WINDOW) -> Index:
    items = sorted({(i, t) for i, t in items if i is not None and t})
    words = kit.Words(pa.array([t for _, t in items], pa.string()), kit.ALNUM, lower=True)
    owner = np.array([i for i, _ in items], dtype=np.int64)
    size = np.minimum(words.count, window)
    parts = []
    for n in np.unique(size[size > 0]).tolist():  # items of fewer words are one window each
        at = kit.window_starts(words.first, n)
        row = np.searchsorted(words.first, at, side="right") - 1
        at, row = at[size[row] == n], row[size[row] == n]
        parts.append((kit.window_hash(words.hash, n, at), np.full(len(at), n), at, owner[row]))
    h, n, at, item = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    order = np.lexsort((item, n, h))
    h, n, at, item = h[order], n[order], at[order], item[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    index = Index(h, n, at, item, np.arange(len(h) + 1), kit.FOLD[words.buf], words.start, words.end, np.zeros(1 << 20, dtype=bool))
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    for k in np.unique(n).tolist():  # windows of one hash and other words than the first of them stay by themselves
        of = np.flatnonzero((n == k) & ~new)
        other = of[~verified(words, index.buf, index, at[of], head[group[of]], k)]
        group[other] = len(head) + np.arange(len(other))
        head = np.concatenate([head, other])
    order = np.argsort(h[head], kind="stable")
    place = np.empty(len(head), dtype=np.int64)
    place[order] = np.arange(len(head))
    pairs = np.unique(np.stack([place[group], item]), axis=1)
    head = head[order]
    index.sieve[(h >> np.uint64(44)).astype(np.int64)] = True
    index.hash, index.size, index.at, index.owner = h[head], n[head], at[head], pairs[1]
    index.bounds = np.searchsorted(pairs[0], np.arange(len(head) + 1))
    return index


def verified(words: kit.Words, folded: np.ndarray, index: Index, at: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
    """Which of the hits (word ``at``, benchmark ``window``) agree word by word."""
    good = np.ones(len(at), dtype=bool)
    for k in range(size):
        live = np.flatnonzero(good)
        mine, theirs = at[live] + k, index.at[window[live]] + k
        long = words.end[mine] - words.start[mine]
        same = long == index.end[theirs] - index.start[theirs]
        good[live[~same]] = False
        live, mine, theirs, long = live[same], mine[same], theirs[same], long[same]
        step = ramp(long)
        differ = folded[np.repeat(words.start[mine], long) + step] != index.buf[np.repeat(index.start[theirs], long) + step]
        good[np.repeat(live, long)[differ]] = False
    return good


def hits_of(words: kit.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """All verified occurrences in a slab: first word and window."""
    folded, found = kit.FOLD[words.buf], []
    for size in np.unique(index.size).tolist():
        starts = kit.window_starts(words.first, size)
        place, window = index.find(kit.window_hash(words.hash, size, starts))
        right = index.size[window] == size
        at, window = starts[place[right]], window[right]
        good = verified(words, folded, index, at, window, size)
        found.append((at[good], window[good]))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, np.int64),) * 2


def characters(buf: np.ndarray) -> np.ndarray:
    """For each byte offset, how many code points start before it."""
    out = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def report(batch: pa.RecordBatch, words: kit.Words, index: Index, at: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """The rows of SCAN for a slab."""
    total = int(words.first[-1])
    hit = kit.covered(total, at, at + index.size[window])
    row = np.searchsorted(words.first, at, side="right") - 1
    n = index.bounds[window + 1] - index.bounds[window]
    pairs = np.unique(np.stack([np.repeat(row, n), index.owner[np.repeat(index.bounds[window], n) + ramp(n)]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    items = [[] for _ in range(batch.num_rows)]
    for r, i in pairs.T.tolist():
        items[r].append(i)
    a, b = kit.runs(hit, words.first)
    spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    if len(a):
        chars = characters(words.buf)
        of = np.searchsorted(words.first, a, side="right") - 1
        base = chars[words.offsets[of]]
        for r, s, e in zip(of.tolist(), (chars[words.start[a]] - base).tolist(), (chars[words.end[b - 1]] - base).tolist(), strict=True):
            spans[r].append({"start": s, "stop": e})
    hits = np.zeros(total + 1, dtype=np.int64)
    np.cumsum(hit, out=hits[1:])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(hits[words.first[1:]] - hits[words.first[:-1]], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, kind)],
        names=["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def measured(benchmark: DataFrame) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: its words, how many lie inside benchmark windows, which items, and the spans.

    Spans are code points, end exclusive, from the first to the last word of each run of hit words.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if measured(benchmark) > broadcast_bytes:
        return _beyond(docs, benchmark, window, lambda part, index: report(part, words := kit.Words(part.column("text"), kit.ALNUM, lower=True), index, *hits_of(words, index)), SCAN)
    sent = docs.sparkSession.sparkContext.broadcast(build([tuple(r) for r in benchmark.select("item_id", "text").collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                words = kit.Words(part.column("text"), kit.ALNUM, lower=True)
                yield report(part, words, sent.value, *hits_of(words, sent.value))

    return docs.mapInArrow(run, SCAN)


def _beyond(docs: DataFrame, benchmark: DataFrame, window: int, each: Callable[[pa.RecordBatch, Index], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``each`` over slabs of the documents and an index of the windows that may be in them: the way
    beyond the broadcast bound. Windows meet by hash, and what was met goes back to its row.

    A row is named by doc_id and the hash of its text, so repeated rows share their hits. Windows
    repeated in a row are sent once, of the sizes that occur; Spark splits what is left of a skewed
    hash. Columns added on the way have names that the documents don't have.
    """
    columns = docs.columns
    taken = {c.lower() for c in columns}
    row_name, found_name = (next(x for i in count() if (x := f"{stem}{i}") not in taken) for stem in ("row", "found"))

    def windows_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                index = build(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)), window)
                n = np.diff(index.bounds)
                full = [bytes(index.buf[s:e]) for s, e in zip(index.start, index.end, strict=True)]
                texts = [b" ".join(full[a : a + k]).decode() for a, k in zip(index.at.tolist(), index.size.tolist(), strict=True)]
                of = np.repeat(np.arange(len(texts)), n)
                yield pa.RecordBatch.from_arrays([pa.array(index.hash[of].view(np.int64)), pa.array(index.size[of].astype(np.int32)), pa.array(index.owner), pa.array(texts, pa.string()).take(pa.array(of))], names=["h", "n", "item_id", "words"])

    entries = cut(benchmark.select("item_id", "text").mapInArrow(windows_of_items, "h bigint, n int, item_id bigint, words string").distinct())
    sizes = [r.n for r in entries.select("n").distinct().collect()]  # ``window`` of them at most
    keyed = docs.withColumn(row_name, F.struct("doc_id", F.xxhash64("text").alias("x")))

    def windows_of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                words = kit.Words(part.column("text"), kit.ALNUM, lower=True)
                row = words.row()
                for size in sizes:
                    starts = kit.window_starts(words.first, size)
                    both = np.unique(np.stack([row[starts], kit.window_hash(words.hash, size, starts).view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("of").take(pa.array(both[0])), pa.array(both[1])], names=["of", "h"])

    pairs = keyed.select(F.col(row_name).alias("of"), "text").mapInArrow(windows_of_docs, "of struct<doc_id:bigint,x:bigint>, h bigint").join(entries, "h")
    found = pairs.groupBy("of").agg(F.collect_set(F.struct("item_id", "words")).alias(found_name))
    both = keyed.join(found, keyed[row_name].eqNullSafe(found["of"]), "left").select(*[keyed[c] for c in docs.columns], found_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                met = {(x["item_id"], x["words"]) for found in part.column(found_name).to_pylist() for x in found or []}
                # each window whole; one that was met by another row of the slab is verified like any other
                yield each(part.select(columns), build(list(met), 1 << 30))

    return both.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The scan with a hash of the item list instead of lists."""
    text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(text.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def cleaned(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    """The rows of a slab without hit spans, less those that lost all their words."""
    words = kit.Words(part.column("text"), kit.ALNUM, lower=True)
    at, window = hits_of(words, index)
    if not len(at):
        return part
    hit = kit.covered(int(words.first[-1]), at, at + index.size[window])
    a, b = kit.runs(hit, words.first)
    cut = kit.covered(len(words.buf), words.start[a], words.end[b - 1])
    kept = np.concatenate([[0], np.cumsum(~hit)])
    left = kept[words.first[1:]] - kept[words.first[:-1]]
    touched = np.bincount(np.searchsorted(words.first, a, side="right") - 1, minlength=part.num_rows) > 0
    size = np.zeros(len(words.buf) + 1, dtype=np.int64)
    np.cumsum(~cut, out=size[1:])
    old = part.column("text").cast(pa.string())
    text = pc.if_else(pa.array(touched), kit.binaries(words.buf[~cut], size[words.offsets]).cast(pa.string()), old)
    columns = list(part.columns)
    columns[part.schema.names.index("text")] = text
    if "n_chars" in part.schema.names:
        i = part.schema.names.index("n_chars")
        columns[i] = pc.if_else(pa.array(touched), pc.utf8_length(text).cast(columns[i].type), columns[i])
    return pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(~touched | (left > 0)))


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, in their columns, without the words of any benchmark window.

    A run of hit words goes with what stands between its words; the rest of the text stays as it is.
    A document left without a word goes too, if it lost one. ``n_chars``, if there, follows the text.
    """
    prepare(docs.sparkSession)
    if measured(benchmark) > broadcast_bytes:
        return _beyond(docs, benchmark, window, cleaned, docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(build([tuple(r) for r in benchmark.select("item_id", "text").collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                yield cleaned(part, sent.value)

    return docs.mapInArrow(run, docs.schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
