"""Byte-level BPE encoding and decoding over whole texts.

Pre-tokens are located without regular expressions: code points become classes (letter, number,
white space, other, and marks for what follows), each class is a transition function over eight
states, and an associative scan composes the functions over blocks of the text, so all blocks of a
slab advance together. The resulting byte slices feed a cache of merged pieces; the token lengths
are retained as offsets, by which ids decode back to the bytes.

Pieces are looked up by a hash once for each slab and compared byte by byte with the one they are
taken for, so a collision changes nothing.

Edge cases: null texts count as empty and give no ids; repeated rows are encoded alike and each is
returned; of pairs with equal rank the leftmost is merged; a piece of any length is merged in
n log n and a very long text is a slab by itself; ids outside the vocabulary raise in ``decode``; an
empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import kit
from tidemark.llm.decontaminate import ramp
from tidemark.session import prepare, table

#: Pieces that a worker keeps merged; beyond, it starts anew (results don't depend on it).
CACHE_PIECES = 400_000

# White space of the pattern's dialect, and letters and numbers assigned after the
# Unicode version of Python's tables but known to the pattern's.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LETTER, NUMBER, OTHER, SPACE_RUN, LAST_SPACE, LAST_WHITE, MARK_1, MARK_2 = range(8)
CONTRACTED_1, CONTRACTED_2 = "stmd", ("re", "ve", "ll")

FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 64


@cache
def classes() -> np.ndarray:
    """The class of every code point, before neighbours are looked at."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            out[point] = LETTER if kind == "L" else NUMBER
    for ranges, value in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE, SPACE_RUN)):
        for lo, hi in ranges:
            out[lo : hi + 1] = value
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(class, state) to the next state and to whether a piece begins; classes + 8 begin a row."""
    to, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    joins = {LETTER: (IN_LETTERS, {IN_LETTERS, AFTER_SPACE}), NUMBER: (IN_NUMBERS, {IN_NUMBERS, AFTER_SPACE}), OTHER: (IN_OTHERS, {IN_OTHERS, AFTER_SPACE}), SPACE_RUN: (IN_SPACE, {IN_SPACE}), LAST_SPACE: (AFTER_SPACE, set()), LAST_WHITE: (FRESH, set())}
    for kind, (state, without_cut) in joins.items():
        to[kind] = state
        cut[kind, list(without_cut)] = False
    for kind, state in ((MARK_1, ONE_LEFT), (MARK_2, TWO_LEFT)):
        to[kind] = state
        to[kind, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        cut[kind, [IN_OTHERS, AFTER_SPACE]] = False
    to[LETTER, ONE_LEFT], to[LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    cut[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    to[8:] = to[:8, [FRESH]]
    return to, cut


TO, CUT = transitions()


def composed(kinds: np.ndarray) -> np.ndarray:
    """The state before each of the code points, by an associative scan over blocks."""
    n = len(kinds)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * 8
    flat, f = TO.ravel(), np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for step in steps:  # each block's function: where each of the eight states leads
        f = flat[step[:, None] + f]
    at = 1
    while at < blocks:  # f[i] becomes the composition of all blocks up to i
        f[at:] = np.take_along_axis(f[at:], f[:-at].astype(np.intp), axis=1)
        at *= 2
    state = np.concatenate([[np.uint8(FRESH)], f[:-1, FRESH]])
    before = np.empty((BLOCK, blocks), dtype=np.uint8)
    for i, step in enumerate(steps):
        before[i] = state
        state = flat[step + state]
    return before.T.ravel()[:n]


def pieces(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of a slab begin."""
    if not len(buf):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n, kinds = len(points), classes()[points]
    first = np.zeros(n + 3, dtype=bool)  # whether a code point begins a row, or is none
    first[np.searchsorted(lead, offsets)] = True
    first[n:] = True
    nxt = np.concatenate([kinds[1:], [np.uint8(SPACE_RUN)]])
    last = (kinds == SPACE_RUN) & (nxt != SPACE_RUN) & ~first[1 : n + 1]
    kinds[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
    marks = np.flatnonzero((points == 0x27) & ~first[1 : n + 1])
    if len(marks):
        one = points[marks + 1]
        kinds[marks[np.isin(one, [ord(c) for c in CONTRACTED_1])]] = MARK_1
        wide = marks[~first[marks + 2]]
        two = points[wide + 1].astype(np.int64) << 32 | points[wide + 2]
        kinds[wide[np.isin(two, [ord(a) << 32 | ord(b) for a, b in CONTRACTED_2])]] = MARK_2
    kinds = kinds + np.uint8(8) * first[:n]
    return lead[CUT[kinds, composed(kinds)]]


class Vocabulary:
    """Ranks of byte strings, with the bytes of all ids in one buffer."""

    def __init__(self, data: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.known = np.zeros(size, dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.bytes, self.byte_at = _flat(words)
        self.digits, self.digit_at = _flat([b"%d " % i for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 16, dtype=np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: always the pair of lowest rank, the leftmost of equals, is joined."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def entry(self, piece: bytes) -> int:
        """The number of a piece in the cache."""
        if (k := self.number.get(piece)) is None:
            ids, k = self.merge(piece), len(self.number)
            if k + 1 >= len(self.at):
                self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
            base = int(self.at[k])
            while base + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
            self.ids[base : base + len(ids)], self.at[k + 1] = ids, base + len(ids)
            self.number[piece] = k
        return k

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slab, the n + 1 bounds of its rows in them, and the slab's bytes and offsets."""
        buf, offsets = kit.raw(column)
        start = pieces(buf, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), buf, offsets
        end = np.append(start[1:], len(buf))
        _, where, which = np.unique(kit.byte_hash(buf, start, end), return_index=True, return_inverse=True)
        if len(self.number) + len(where) > CACHE_PIECES:
            self.clear()
        text = buf.tobytes()
        known = np.array([self.entry(text[s:e]) for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)], dtype=np.int64)[which]
        for i in np.flatnonzero(~kit.same_bytes(buf, start, end, where[which])).tolist():  # equal hashes of unequal pieces
            known[i] = self.entry(text[start[i] : end[i]])
        size = self.at[known + 1] - self.at[known]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.at[known], size) + ramp(size)], total[np.searchsorted(start, offsets)], buf, offsets

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the n + 1 offsets of the ids in them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        return _gather(self.bytes, self.byte_at, ids)

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.digits, self.digit_at, ids)


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([0] + [len(w) for w in words])


def _gather(buf: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = at[ids + 1] - at[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    return buf[np.repeat(at[ids] - ends[:-1], size) + np.arange(int(ends[-1]))], ends


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(sent: Broadcast) -> Vocabulary:
    """This worker's vocabulary, with its cache of pieces, across tasks."""
    key = hashlib.sha256(sent.value).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(sent.value)
    return _loaded[key]


def _send(spark: SparkSession, ranks: str) -> Broadcast:
    """The rank file, whose size is that of the vocabulary and doesn't grow with the data."""
    with open(ranks, "rb") as f:
        return prepare(spark).sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document its ids and, for decoding, the byte offset at which each token begins."""
    sent = _send(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                own = vocabulary(sent)
                ids, bounds, _, offsets = own.encode(part.column("text"))
                begins = own.decode(ids)[1][:-1] - np.repeat(offsets[:-1], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (ids, begins.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Texts of rows with ``doc_id`` and ``ids``; bytes that aren't UTF-8 become U+FFFD."""
    sent = _send(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vocabulary(sent)
            texts = [own.decode(np.array(ids or [], dtype=np.int64))[0].tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode, decode what was encoded, and hash both, one slab at a time."""
    sent = _send(docs.sparkSession, ranks)

    def hashes(buf: np.ndarray, bounds: np.ndarray, drop: int) -> pa.Array:
        view = memoryview(np.ascontiguousarray(buf))
        return pa.array([hashlib.sha256(view[a : max(a, b - drop)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                own = vocabulary(sent)
                ids, bounds, _, _ = own.encode(part.column("text"))
                text, text_at = own.decimal(ids)
                back, back_at = own.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), hashes(text, text_at[bounds], 1), hashes(back, back_at[bounds], 0)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def production_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), production_ranks())
