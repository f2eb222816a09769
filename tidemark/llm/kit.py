"""Vectorised text primitives: words, 64-bit hashes and windows of whole Arrow batches.

A *slab* is a run of rows with about ``SLAB`` bytes of text; arrays per slab bound a Python
worker's memory, whatever the Arrow batch holds. A row longer than that is a slab by itself.
Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 1 << 20
U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table_of(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: Bytes inside words, for the two word definitions; bytes of multi-byte characters always are.
SPACED = table_of([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = table_of([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

#: ASCII letters in lower case, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

STEP, SEEDS = U64(0x9E3779B97F4A7C15), (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Slices of more bytes than this are hashed one by one by a cryptographic hash.
LONG = 256
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; equal inputs stay equal and unequal ones unequal."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * MIX_A
        h = (h ^ (h >> U64(27))) * MIX_B
        return h ^ (h >> U64(31))


def slabs(batch: pa.RecordBatch, column: str = "text", limit: int = SLAB) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return buf, o - o[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, broken at row borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders] = False
    after[borders - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """The words of a slab: byte spans, hashes, and ``first[i]:first[i+1]`` as those of row i."""

    def __init__(self, column: pa.Array, inside: np.ndarray, lower: bool, second: bool = False) -> None:
        self.buf, self.offsets = raw(column)
        self.start, self.end = runs(inside[self.buf], self.offsets)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        buf = FOLD[self.buf] if lower else self.buf
        self.hash = byte_hash(buf, self.start, self.end)
        self.hash2 = byte_hash(buf, self.start, self.end, 1) if second else None

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def lanes(buf: np.ndarray) -> np.ndarray:
    """For each byte the eight from it on, as one number; zeros follow the last."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))


def byte_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte slices: eight bytes at a time go through a mixing function.

    No sum of powers, which Thue-Morse strings defeat whatever the base; slices of more than
    ``LONG`` bytes are hashed by BLAKE2.
    """
    size = end - start
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * STEP ^ U64(SEEDS[which]))
        data, at = lanes(buf), np.flatnonzero((size > 0) & (size <= LONG))
        done = 0
        while len(at):
            left = size[at] - done
            h[at] = mix((h[at] * STEP) ^ (data[start[at] + done] & _MASKS[np.minimum(left, 8)]))
            done += 8
            at = at[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which slices have the bytes of the slice that ``other`` names, by its place among them."""
    size = end - start
    same = size == size[other]
    data, done, at = lanes(buf), 0, np.flatnonzero(same & (size > 0) & (size <= LONG))
    while len(at):
        left = size[at] - done
        equal = ((data[start[at] + done] ^ data[start[other[at]] + done]) & _MASKS[np.minimum(left, 8)]) == 0
        same[at[~equal]] = False
        done += 8
        at = at[equal & (left > 8)]
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        j = int(other[i])
        same[i] = np.array_equal(buf[start[i] : end[i]], buf[start[j] : end[j]])
    return same


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    total = int(first[-1]) if len(first) else 0
    if total < n:
        return np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(left >= n)


def window_hash(h: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of ``h[s:s+n]`` for each start: halves are joined by a mixing function, log n times."""
    with np.errstate(over="ignore"):
        level, width, out, done = h, 1, np.full(len(starts), U64(n), dtype=np.uint64), 0
        while width <= n:
            if n & width:
                out = mix((out * STEP) ^ level[starts + done])
                done += width
            width *= 2
            if width <= n:
                level = mix((level[: -(width // 2)] * STEP) + mix(level[width // 2 :] ^ STEP)) if len(level) > width // 2 else level[:0]
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As window_hash, with a length for each start."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for n in np.unique(ends - starts).tolist():
        of = np.flatnonzero(ends - starts == n)
        out[of] = window_hash(h, n, starts[of])
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in at least one of the half-open spans."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def binaries(buf: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is ``buf[offsets[i]:offsets[i+1]]``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())


def sample(docs: DataFrame, rows: int, salt: int = 0) -> DataFrame:
    """``rows`` of the rows, those first by a hash of doc_id; all if there are no more.

    The choice reads doc_id only and brings ``rows + 1`` hashes to the driver; the rows stay where
    they are. Rows whose hash ties with the last one chosen (repeated or null ids) are told apart by a
    hash of their text, equal texts by their place in the scan.
    """
    point = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40))
    n = docs.count()
    if n <= rows:
        return docs
    first: list[int] = []
    for share in (1.25 * rows / n + 100 / n, 2.0):  # a little more than is taken, else all
        if len(first) <= rows:
            first = [r.at for r in docs.select(point.alias("at")).where(F.col("at") < int(share * (1 << 40))).orderBy("at").limit(rows + 1).collect()]
    last = first[rows - 1]
    if first[rows] > last:
        return docs.where(point <= last)
    place = next(x for i in count() if (x := f"place{i}") not in {c.lower() for c in docs.columns})
    placed, text = docs.withColumn(place, F.monotonically_increasing_id()), F.coalesce(F.xxhash64("text", F.lit(salt)), F.lit(0))
    left = rows - sum(at < last for at in first[:rows])
    end = placed.where(point == last).select(text.alias("text"), F.col(place).alias("place")).orderBy("text", "place").limit(left).collect()[-1]
    tied = (point == last) & ((text < end["text"]) | (text == end["text"]) & (F.col(place) <= end["place"]))
    return placed.where((point < last) | tied).drop(place)
