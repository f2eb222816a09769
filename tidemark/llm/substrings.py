"""Substring dedup by difference-cover anchors.

Words of a text are numbered from 0. Short windows (*anchors*) are hashed only where the number
modulo a period lies in a difference cover: for any two places some shift below the period takes
both into the cover, so two equal long windows always share an aligned anchor. Anchors that occur in
more than one document then extend to the long windows around them, which are told apart by 96 bits of hashes that
mix the bytes of their words (two of ten trillion windows are confused with a chance of about 1e-3).

Texts are dealt once into *slabs* of about ``SLAB_BYTES`` by a hash of the row; each slab sends an
anchor or window once, whatever its number of copies there, so a passage that a third of all
documents share gives a row for each slab at most. Nothing is collected.

A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are
judged on the input. Edge cases: null, empty and short texts keep their words; rows with a null
doc_id keep all and take from none; repeated rows of one doc_id don't take from each other, so no tie
is left; a very long text is part of one slab; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.llm.decontaminate import ramp
from tidemark.session import prepare, table

WINDOW = 13
SLAB_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20

# Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least half the window."""
    period = max(v for v in COVERS if window - v + 1 >= max(1, window // 2))
    return period, COVERS[period]


class Deal:
    """How a corpus of ``size`` bytes of text is dealt: slabs, buckets of hashes, bits of a hash.

    Anchors only filter, so their hashes are cut to eight bits more than it takes to count the
    bytes: they stay almost unique at any size, and sorted ones take few bytes each.
    """

    def __init__(self, docs: DataFrame) -> None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.slabs = max(least, size // SLAB_BYTES)
        self.bits = min(64, max(36, size.bit_length() + 8))
        self.bucket_bits = (max(least, size // BUCKET_BYTES) - 1).bit_length()


def slabs_of(docs: DataFrame, deal: Deal) -> DataFrame:
    """doc_id and text, dealt by slab."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(deal.slabs)).alias("slab"), "doc_id", "text").repartition("slab")


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, in four bytes each where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    small = not len(steps) or int(steps[1:].max(initial=0)) < 1 << 32
    return bytes([small]) + keys[:1].tobytes() + (steps[1:].astype(np.uint32) if small else steps[1:]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    rest = np.frombuffer(data, dtype=np.uint32 if data[0] else np.uint64, offset=9) if len(data) > 9 else np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, dtype=np.uint64, count=1, offset=1), rest.astype(np.uint64)]), dtype=np.uint64)


class Slab:
    """Words of a slab, with the document of each."""

    def __init__(self, rows: pa.Table, second: bool) -> None:
        rows = rows.combine_chunks()
        self.text = rows.column("text")
        self.words = kit.Words(self.text, kit.SPACED, lower=False, second=second)
        ids = rows.column("doc_id")
        self.ids = ids
        self.known = pc.is_valid(ids).to_numpy()
        self.doc = pc.fill_null(ids, 0).to_numpy()
        self.row = self.words.row()

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the anchors."""
        period, cover = cover_for(window)
        width = window - period + 1
        starts = kit.window_starts(self.words.first, width)
        inside = np.zeros(period, dtype=bool)
        inside[list(cover)] = True
        starts = starts[inside[(starts - self.words.first[self.row[starts]]) % period] & self.known[self.row[starts]]]
        return starts, kit.window_hash(self.words.hash, width, starts)

    def windows(self, window: int) -> np.ndarray:
        starts = kit.window_starts(self.words.first, window)
        return starts[self.known[self.row[starts]]]

    def names(self, window: int, starts: np.ndarray) -> np.ndarray:
        """Hashes of each window, of 64 and of 32 bits, as rows."""
        first, second = kit.window_hash(self.words.hash, window, starts), kit.window_hash(self.words.hash2, window, starts)
        return np.stack([first, second >> np.uint64(32)], axis=1).view(np.int64)


def least(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (rows), the least document of each, and the place of each given row's key."""
    order = np.lexsort(keys.T[::-1])
    if not len(order):
        return keys, doc, order
    sorted_keys = keys[order]
    new = np.concatenate([[True], (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return sorted_keys[begin], np.minimum.reduceat(doc[order], begin), place


def _anchor_rows(window: int, deal: Deal) -> Callable[[pa.Table], pa.Table]:
    """The slab's anchors, packed by bucket."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.unique(Slab(rows, second=False).anchors(window)[1] >> np.uint64(64 - deal.bits))
        bucket = keys >> np.uint64(deal.bits - deal.bucket_bits)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
        parts = [packed(x) for x in np.split(keys, begin[1:])] if len(keys) else []
        return pa.table({"bucket": bucket[begin].astype(np.int64), "slab": pa.array([rows["slab"][0].as_py()] * len(parts), pa.int64()), "keys": pa.array(parts, pa.binary())})

    return run


def _shared_rows(rows: pa.Table) -> pa.Table:
    """Of a bucket's anchors those in several slabs, packed for each slab."""
    parts = [unpacked(x) for x in rows["keys"].to_pylist()]
    keys, slab = np.concatenate(parts), np.repeat(rows["slab"].to_numpy(), [len(x) for x in parts])
    order = np.argsort(keys, kind="stable")
    keys, slab = keys[order], slab[order]
    same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    met = same[1:] | same[:-1]
    keys, slab = keys[met], slab[met]
    order = np.lexsort((keys, slab))
    keys, slab = keys[order], slab[order]
    begin = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]])) if len(slab) else np.zeros(0, np.int64)
    return pa.table({"slab": slab[begin], "keys": pa.array([packed(x) for x in np.split(keys, begin[1:])] if len(slab) else [], pa.binary())})


def _window_rows(window: int, deal: Deal) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Windows around anchors of other slabs, and the least document that has each in this one."""

    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        if not rows.num_rows or not shared.num_rows:
            return pa.table({k: pa.array([], pa.int32() if k == "h2" else pa.int64()) for k in ("h1", "h2", "slab", "lo")})
        slab = Slab(rows, second=True)
        starts, h = slab.anchors(window)
        met = np.zeros(len(slab.words.start) + 1, dtype=np.int64)
        met[1 + starts[np.isin(h >> np.uint64(64 - deal.bits), np.concatenate([unpacked(x) for x in shared["keys"].to_pylist()]))]] = 1
        met = np.cumsum(met)
        windows = slab.windows(window)
        windows = windows[met[windows + cover_for(window)[0]] > met[windows]]
        keys, lo, _ = least(slab.names(window, windows), slab.doc[slab.row[windows]])
        return pa.table({"h1": keys[:, 0], "h2": keys[:, 1].astype(np.uint32).view(np.int32), "slab": pa.array([rows["slab"][0].as_py()] * len(keys), pa.int64()), "lo": lo})

    return run


def _kept_rows(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The texts without words of windows that a smaller doc_id has, here or in another slab."""

    def run(rows: pa.Table, taken: pa.Table) -> pa.Table:
        slab = Slab(rows, second=True)
        words = slab.words
        starts = slab.windows(window)
        doc = slab.doc[slab.row[starts]]
        keys, lo, place = least(slab.names(window, starts), doc)
        if taken.num_rows and len(keys):
            theirs = np.stack([taken["h1"].to_numpy(), taken["h2"].to_numpy().view(np.uint32).astype(np.int64)], axis=1)
            both, low, where = least(np.concatenate([keys, theirs]), np.concatenate([lo, taken["lo"].to_numpy()]))
            lo = low[where[: len(keys)]]
        starts = starts[doc > lo[place]]
        drop = kit.covered(len(words.start), starts, starts + window)
        kept = np.flatnonzero(~drop)
        row = slab.row[kept]
        size = words.end[kept] - words.start[kept]
        more = np.zeros(len(kept), dtype=np.int64)
        more[:-1] = row[1:] == row[:-1]
        full = size + more
        step = ramp(full)
        text = words.buf[np.minimum(np.repeat(words.start[kept], full) + step, max(len(words.buf) - 1, 0))] if len(words.buf) else words.buf
        text = np.where(step < np.repeat(size, full), text, np.uint8(32)).astype(np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=full, minlength=rows.num_rows).astype(np.int64))])
        gone = words.count - np.bincount(row, minlength=rows.num_rows)
        return pa.table({"doc_id": slab.ids, "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "text": kit.binaries(text, bounds).cast(pa.string())})

    return run


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and text, the kept words joined by one space."""
    prepare(docs.sparkSession)
    deal = Deal(docs)
    dealt = slabs_of(docs, deal)
    by = lambda df: df.groupBy("slab")
    anchors = by(dealt).applyInArrow(_anchor_rows(window, deal), "bucket bigint, slab bigint, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_rows, "slab bigint, keys binary")
    windows = by(dealt).cogroup(by(shared)).applyInArrow(_window_rows(window, deal), "h1 bigint, h2 int, slab bigint, lo bigint")
    taken = windows.withColumn("least", F.min("lo").over(Window.partitionBy("h1", "h2"))).where("least < lo").select("slab", "h1", "h2", F.col("least").alias("lo"))
    return by(dealt).cogroup(by(taken)).applyInArrow(_kept_rows(window), "doc_id bigint, n_words bigint, n_removed bigint, text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup(table(spark, sf_dir, "documents")))
