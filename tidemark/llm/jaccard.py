"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

The universe of shingles is partitioned into m segments by a hash, m chosen by band of set sizes:
sets at the threshold differ in at most H shingles, so if exact segments count one, segments with a
one-deletion neighbourhood count two and the sum passes H, similar sets share a signature. How many
segments are of which kind is the cheapest allocation under a cost of rows and of chance matches.
A set is signed for its own band and, as the smaller partner, for the next.

Where all segments are exact there are some more of them than H + 1, so a similar pair shares a
subset of several. A set may then leave out a number of those of empty segments, and of the others
as many of the ones that most sets have, by one order for all sets; similar pairs still share
``common`` of what is left, and pairs that share fewer are let go. So a line that a third of all
documents share brings none of them together.

Signatures travel as sorted hashes in packs by bucket. A bucket gives the pairs of small groups and
the rows of groups of more than ``SMALL``. There only a *hub* (the set most often met; for hubs that are alike, the one met most of
them) is compared with every member; two members that are not both similar to the hub can only be similar
if they share enough shingles of their differences from it (else their distance is too near the sum
of both), so those that may are regrouped by (hub, shingle of the difference) until none is left.
Members that hubs leave meet by the rarest shingles of their differences, in groups of at most
``PAIRED``, and larger ones get hubs of their own. No pair is lost, none is capped, and a group of k
near copies costs about k comparisons instead of k * k.

Equal sets are one class, named by two 64-bit hashes and the size; its id is the least doc_id. The
two come from word hashes of two seeds, and shingles from both, so words that collide under one seed
stay apart. The hashes of nodes and signatures in packs only filter. A sketch (how many shingles fall in each of some
counters) rules out pairs whose counts differ too much; all others are compared by their whole sets
of 64-bit shingle hashes.

Edge cases: null, empty and wordless texts have empty sets and link with nothing; a text of fewer
words than n is one shingle; rows with a null doc_id are returned but name no component; repeated
rows, and different texts of one doc_id, are rows of their own (equal ones in one component); a very
long text is a slab by itself; ties of hubs go to the greater id, of signatures to the lesser hash;
columns besides doc_id and text are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.llm.decontaminate import ramp
from tidemark.llm.substrings import packed, unpacked
from tidemark.operators.components import components
from tidemark.session import Scratch, cut, prepare, table

NGRAM, PERCENT = 3, 90
#: Members of a group that are compared directly; the same for what hubs leave.
SMALL, PAIRED = 8, 256
#: Most doc_ids sent to every executor (24 bytes each).
BROADCAST_IDS = 500_000
#: For the allocation: the cost of a hot signature against that of a row, and the share of hot shingles.
CHANCE, HOT = 1e3, 0.2
#: Most members of a hub whose sketches are compared before their differences are, and of a block; and
#: how many pairs for each member of two blocks are compared at once.
CHECKED, CHECK_BLOCK, CHECK_PAIRS = 1 << 14, 512, 4
#: Signatures that a Python worker packs at a time, and bytes of a bucket of packs.
FLUSH, BUCKET_BYTES = 1 << 20, 8 << 20
#: Bits of a node's hash in a pack, beside one for whether it is in its own band.
NODE_BITS = 39


@cache
def bands(percent: int) -> np.ndarray:
    """Least sizes of the bands: similar sets are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, dtype=np.int64)


class Allocation(NamedTuple):
    """Segments of a band, how many signatures a set may leave out (empty and frequent ones), and how
    many a similar pair shares of the others."""

    exact: int
    deleted: int
    empties: int
    frequent: int
    common: int


def _exceeds(k: int, mean: float, variance: float) -> float:
    """The chance that a count of this mean and variance exceeds k."""
    return 0.5 * math.erfc((k + 0.5 - mean) / math.sqrt(2 * variance)) if variance > 0 else float(mean > k)


@cache
def allocation(band: int, percent: int) -> Allocation:
    """The cheapest allocation for a band; no segments where only equal sets are similar.

    With m exact segments and most differences H, a similar pair shares m - H signatures; one of
    them is spared for two signatures of a set that collide. The cost takes ``HOT`` of the shingles
    for ones that many sets have, and a segment of such alone for a hot one.
    """
    lo, hi = int(bands(percent)[band]), int(bands(percent)[band + 1]) - 1
    most = 2 * hi * (100 - percent) // (100 + percent)
    if not most:
        return Allocation(0, 0, 0, 0, 0)
    found = []
    for d in sorted({round(most / 2 * i / 16) for i in range(17)} | {(most + 2) // 2}):
        e = max(most + 1 - 2 * d, 0)
        if e + d:
            each = lo / (e + d)
            found.append((e + d * (1 + each) + CHANCE * (e * math.exp(-each) + d * (1 + each) * math.exp(-each)), Allocation(e, d, 0, 0, 1)))
    common = 2 + most // 12
    empties = 0
    while empties <= 4 * lo:
        frequent = 0
        while frequent <= most + 2:
            m = most + 1 + empties + frequent + common
            each = lo / m
            void = math.exp(-each)
            mean, hot = m * void, m * (math.exp(-each * (1 - HOT)) - void)
            cost = m - mean + CHANCE * (_exceeds(empties, mean, mean * (1 - (1 + each) * void)) + _exceeds(frequent, hot, hot))
            found.append((cost, Allocation(m, 0, empties, frequent, common)))
            frequent += 1 + frequent // 6
        empties += 1 + empties // 6
    return min(found)[1]


class Sets:
    """Distinct shingles of a slab's rows: ``shingle[first[i]:first[i+1]]`` sorted, for row i."""

    def __init__(self, column: pa.Array, n: int) -> None:
        words = kit.Words(column, kit.SPACED, lower=True, second=True)
        starts = kit.window_starts(words.first, n)
        row = np.searchsorted(words.first, starts, side="right") - 1
        short = np.flatnonzero((words.count > 0) & (words.count < n))
        with np.errstate(over="ignore"):
            both = kit.mix(words.hash * kit.STEP ^ words.hash2)
        h, h2 = (np.concatenate([kit.window_hash(x, n, starts), kit.span_hash(x, words.first[short], words.first[short + 1])]) for x in (both, words.hash2))
        row = np.concatenate([row, short])
        bits = np.uint64(max(1, len(words.count).bit_length()))
        key = row.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits
        order = np.argsort(key)
        if len(h) and ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
            order = np.lexsort((h, row))  # hashes of a row that differ only in the bits left out
        h, h2, row = h[order], h2[order], row[order]
        if len(h):
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            h, h2, row = h[keep], h2[keep], row[keep]
        self.shingle, self.row = h, row
        self.first = np.searchsorted(row, np.arange(len(words.count) + 1))
        self.size = np.diff(self.first)
        self.name, self.name2 = (self._name(x, salt) for x, salt in ((h, np.uint64(0xA5A5)), (h2, np.uint64(0x3C3C << 32))))

    def _name(self, shingle: np.ndarray, salt: np.uint64) -> np.ndarray:
        total = np.zeros(len(shingle) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(kit.mix(kit.mix(shingle ^ salt) + kit.STEP), out=total[1:])
            return kit.mix((total[self.first[1:]] - total[self.first[:-1]]) ^ self.size.astype(np.uint64)).view(np.int64)

    def sketches(self) -> pa.Array:
        """For each row how many shingles fall in each of a power of two of counters, 255 at most."""
        width = 1 << np.maximum(3, np.log2(np.maximum(self.size, 1)).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(width)])
        place = bounds[self.row] + (kit.mix(self.shingle ^ np.uint64(0x5C)) & (width[self.row] - 1).astype(np.uint64)).astype(np.int64)
        return kit.binaries(np.minimum(np.bincount(place, minlength=int(bounds[-1])), 255).astype(np.uint8), bounds)

    def signatures(self, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of the given rows (with non-empty sets), their rows, and whether of the own band."""
        out = []
        own = np.searchsorted(bands(percent), self.size[rows], side="right") - 1
        for step in (0, 1):
            for band in np.unique(own).tolist():
                exact, deleted, empties, *_ = allocation(band + step, percent)
                if not (m := exact + deleted):
                    continue
                some = rows[own == band]
                at = np.repeat(self.first[some], self.size[some]) + ramp(self.size[some])
                token = kit.mix(self.shingle[at])
                segment = (kit.mix(self.shingle[at] ^ np.uint64(band + step + 1)) % np.uint64(m)).astype(np.int64)
                place = np.repeat(np.arange(len(some)), self.size[some]) * m + segment
                total = np.zeros(len(some) * m, dtype=np.uint64)
                np.add.at(total, place, token)
                salt = kit.mix(np.arange(m, dtype=np.uint64) + np.uint64((band + step) << 32))
                empty = np.bincount(place, minlength=len(total)).reshape(-1, m) == 0
                used = (~empty | (np.cumsum(empty, axis=1) > empties)).ravel()
                out.append((kit.mix(total.reshape(-1, m) ^ salt).ravel()[used], np.repeat(some, m)[used], step == 0))
                if deleted:
                    near = segment < deleted
                    with np.errstate(over="ignore"):
                        out.append((kit.mix((total[place[near]] - token[near]) ^ salt[segment[near]]), some[place[near] // m], step == 0))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.repeat([x[2] for x in out], [len(x[0]) for x in out])


class Deal:
    """How signatures of ``size`` bytes of text are dealt: bits of a key, buckets, partitions."""

    def __init__(self, docs: DataFrame) -> None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.bits = min(63, max(36, size.bit_length() + 8))
        self.bucket_bits = (max(least, size // BUCKET_BYTES) - 1).bit_length()
        self.parts = max(least, size // (2 * BUCKET_BYTES))


def _over(docs: DataFrame, schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], *columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch, limit=2 * kit.SLAB):
                yield make(part)

    return docs.select(*columns).mapInArrow(run, schema)


NAMES = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, own_out int, next_out int, own_common int, next_common int, sketch binary"
NAME_COLUMNS = [c.split()[0] for c in NAMES.split(", ")]
PACK = "bucket bigint, keys binary, nodes binary"
MET = f"kind string, gid bigint, a bigint, b bigint, own boolean, k bigint, {NAMES}"


def _names(part: pa.RecordBatch, sets: Sets, percent: int) -> pa.RecordBatch:
    """A row for each text: its set's names and sketch, and what its bands leave out and have in common."""
    band = np.searchsorted(bands(percent), np.maximum(sets.size, 1), side="right") - 1
    plans = [[allocation(b + step, percent) for b in band.tolist()] for step in (0, 1)]
    out = [np.array([getattr(a, what) for a in plan], dtype=np.int32) for what in ("frequent", "common") for plan in plans]
    void = sets.size == 0
    columns = [part.column("doc_id"), pa.array(sets.size, pa.int64()), pa.array(sets.name, mask=void), pa.array(sets.name2, mask=void), *map(pa.array, out), sets.sketches()]
    return pa.RecordBatch.from_arrays(columns, names=NAME_COLUMNS)


def _node(name: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The part of a name that travels, above a bit for the own band."""
    return (name.view(np.uint64) >> np.uint64(64 - NODE_BITS)) << np.uint64(1) | own.astype(np.uint64)


def _distinct(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and node, one for each; in its own band if one of them is."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    last = np.ones(len(key), dtype=bool)
    last[:-1] = (key[1:] != key[:-1]) | (node[1:] >> np.uint64(1) != node[:-1] >> np.uint64(1))
    return key[last], node[last]


def signed(docs: DataFrame, n: int, percent: int, deal: Deal) -> DataFrame:
    """Packs of signatures by bucket, and the names of all texts (packs without nodes)."""

    def flush(key: list[np.ndarray], node: list[np.ndarray]) -> pa.RecordBatch:
        k, v = _distinct(np.concatenate(key), np.concatenate(node))
        bucket = k >> np.uint64(deal.bits - deal.bucket_bits)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(k) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(k))
        keys = [packed(k[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        low, high = v.astype(np.uint32), (v >> np.uint64(32)).astype(np.uint8)
        nodes = [low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary())], names=["bucket", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, held = [], [], 0
        for batch in batches:
            for part in kit.slabs(batch, limit=2 * kit.SLAB):
                sets = Sets(part.column("text"), n)
                names = _names(part, sets, percent)
                at = int(sets.name.view(np.uint64).sum() >> np.uint64(64 - deal.bucket_bits)) if deal.bucket_bits else 0
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([bytes(names.serialize())]), pa.array([None], pa.binary())], names=["bucket", "keys", "nodes"])
                rows = np.flatnonzero((sets.size > 0) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
                rows = rows[np.unique(sets.name[rows], return_index=True)[1]]
                sig, row, own = sets.signatures(rows, percent)
                key.append(sig >> np.uint64(64 - deal.bits))
                node.append(_node(sets.name[row], own))
                held += len(sig)
                if held >= FLUSH:
                    yield flush(key, node)
                    key, node, held = [], [], 0
        if held:
            yield flush(key, node)

    return docs.select("doc_id", "text").mapInArrow(run, PACK)


def _pairs(node: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of the members of groups, one of each in its own band, and in how many they met."""
    out = []
    for k in np.unique(size).tolist():
        members = node[begin[size == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                a, b = members[:, i], members[:, j]
                met = (a | b) & np.uint64(1) > 0
                out.append(np.stack([a[met], b[met]], axis=1) >> np.uint64(1))
    both, times = np.unique(np.concatenate(out), axis=0, return_counts=True) if out else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    both = both.view(np.int64)
    return both[:, 0], both[:, 1], times


def _meet(rows: pa.Table) -> pa.Table:
    """Of a bucket the pairs of small groups, the rows of large ones, and the names that came along."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
    names_schema = pa.schema(list(zip(NAME_COLUMNS, kinds, strict=True)))
    keys, nodes = rows["keys"].to_pylist(), rows["nodes"].to_pylist()
    names = [pa.ipc.read_record_batch(pa.py_buffer(x), names_schema) for x, y in zip(keys, nodes, strict=True) if y is None]
    some = pa.Table.from_batches(names, names_schema)
    keys, nodes = [unpacked(x) for x, y in zip(keys, nodes, strict=True) if y is not None], [y for y in nodes if y is not None]
    if keys:
        low = np.concatenate([np.frombuffer(x, dtype=np.uint32, count=len(x) // 5) for x in nodes])
        high = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=len(x) // 5 * 4) for x in nodes])
        key, node = _distinct(np.concatenate(keys), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
    else:
        key, node = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    own = np.maximum.reduceat(node & np.uint64(1), begin) > 0 if len(key) else np.zeros(0, bool)
    small, large = own & (size > 1) & (size <= SMALL), own & (size > SMALL)
    a, b, times = _pairs(node, begin[small], size[small])
    at = np.repeat(begin[large], size[large]) + ramp(size[large])
    no = lambda t, n: pa.nulls(n, t)
    columns = {
        "kind": pa.concat_arrays([pa.array([x] * n, pa.string()) for x, n in (("pair", len(a)), ("large", len(at)), ("name", len(some)))]),
        "gid": pa.concat_arrays([no(pa.int64(), len(a)), pa.array(key[at].astype(np.int64)), no(pa.int64(), len(some))]),
        "a": pa.concat_arrays([pa.array(a), pa.array((node[at] >> np.uint64(1)).astype(np.int64)), no(pa.int64(), len(some))]),
        "b": pa.concat_arrays([pa.array(b), no(pa.int64(), len(at) + len(some))]),
        "own": pa.concat_arrays([no(pa.bool_(), len(a)), pa.array((node[at] & np.uint64(1)) > 0), no(pa.bool_(), len(some))]),
        "k": pa.concat_arrays([pa.array(times, pa.int64()), pa.array(np.repeat(size[large], size[large])), no(pa.int64(), len(some))]),
    }
    for field in names_schema:
        columns[field.name] = pa.concat_arrays([no(field.type, len(a) + len(at)), *some[field.name].chunks])
    return pa.table(columns)


def met(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of MET, by kind: pairs (a, b) of nodes that met k times, rows (gid, a, own, k) of large groups, names."""
    deal = Deal(docs)
    return signed(docs, n, percent, deal).repartition(deal.parts, "bucket").groupBy("bucket").applyInArrow(_meet, MET)


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, star) whose sizes and sketches don't rule out that they are similar; all stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            n = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            width = [batch.column(f"sketch_{x}").cast(pa.large_binary()) for x in "ab"]
            width = [np.diff(np.frombuffer(w.buffers()[1], dtype=np.int64)[w.offset : w.offset + len(w) + 1]) for w in width]
            data = [np.frombuffer(b"".join(batch.column(f"sketch_{x}").to_pylist()), dtype=np.uint8) for x in "ab"]
            at = [np.cumsum(w) - w for w in width]
            for wa, wb in np.unique(np.stack(width, axis=1), axis=0).tolist():
                rows = np.flatnonzero((width[0] == wa) & (width[1] == wb))
                w = min(wa, wb)  # the wider one is folded
                a, b = (folded(data[i], at[i][rows], v, w) for i, v in ((0, wa), (1, wb)))
                keep[rows] = np.abs(a - b).sum(axis=1) <= (n[0] + n[1])[rows] * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("star")], names=["a", "b", "star"]).filter(pa.array(keep))

    return pairs.select("a", "b", "star", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint, star boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, star) with whether they are similar and, for stars, their difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, differ = [], []
            for x, y, star in zip(batch.column("set_a"), batch.column("set_b"), batch.column("star").to_pylist(), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                rest = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(rest)) // 2
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                differ.append(rest.view(np.int64) if star else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("size_a"), batch.column("size_b"), pa.array(linked, pa.bool_()), pa.array(differ, pa.list_(pa.int64()))], names=["a", "b", "size_a", "size_b", "linked", "differ"])

    a, b = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    both = pairs.join(b, "b").join(a, "a").where(f"star or 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    return both.select("a", "b", "size_a", "size_b", "star", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, size_a bigint, size_b bigint, linked boolean, differ array<bigint>")


def bound(percent: int, *sizes: str) -> str:
    """The most in which similar sets of these sizes (or a set of this size and any) differ."""
    return f"floor(({' + '.join(sizes)}) * {100 - percent} / {100 + percent if len(sizes) > 1 else percent})"


def pruned(tokens: DataFrame) -> DataFrame:
    """Shingles of differences, (hub, node, e, h, own, partner, shingle), that a similar pair may share.

    Let E be the size of a member's difference from the hub, F how many of its shingles another
    member's has too, and H the most in which the member can differ from a similar set. A similar
    pair shares at least (E + E' - H) / 2 of them, thus neither F is less. So a member that isn't
    similar to the hub (own) stays only if E - H <= max(2 F' - E'), and another as its partner only
    if 2 F - E >= min(E' - H'), the bounds being those of the members of the hub.
    """
    met = tokens.groupBy("hub", "shingle").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("k > 1 and some").select("hub", "shingle")
    tokens = tokens.join(met, ["hub", "shingle"])
    members = tokens.groupBy("hub", "node", "e", "h", "own", "partner").agg(F.count("*").alias("f"))
    bounds = members.groupBy("hub").agg(F.max(F.expr("if(partner, 2 * f - e, null)")).alias("most"), F.min(F.expr("if(own, e - h, null)")).alias("least"))
    judged = members.join(bounds, "hub").select("hub", "node", F.expr("own and coalesce(e - h <= most, false)").alias("own"), F.expr("partner and coalesce(2 * f - e >= least, false)").alias("partner"))
    return cut(tokens.drop("own", "partner").join(judged.where("own or partner"), ["hub", "node"]))


def prefixed(tokens: DataFrame) -> DataFrame:
    """The rarest shingles of each difference, two of which meet in any pair that can be similar.

    A member shares at least t of its F shingles with a similar one, so one of its F - t + 1 rarest:
    t is E - H, and half of E + E' - H for the least E' it can pair with, whichever is more.
    """
    size = tokens.groupBy("hub", "shingle").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("k > 1 and some").select("hub", "shingle", "k")
    tokens = tokens.join(size, ["hub", "shingle"])
    members = tokens.groupBy("hub", "node").agg(F.count("*").alias("f"))
    least = tokens.groupBy("hub").agg(F.min("e").alias("any_e"), F.min(F.expr("if(own, e, null)")).alias("own_e"))
    shared = "greatest(1, e - h, ceil((e + if(own, any_e, own_e) - h) / 2))"
    rank = F.row_number().over(Window.partitionBy("hub", "node").orderBy("k", "shingle"))
    ranked = tokens.join(members, ["hub", "node"]).join(least, "hub").withColumn("i", rank)
    return ranked.where(f"i <= f - {shared} + 1").select("hub", "shingle", "node", "e", "n", "own", "partner", "f")


def folded(data: np.ndarray, at: np.ndarray, width: int, to: int) -> np.ndarray:
    """Sketches of one width that begin at the given places, in ``to`` counters."""
    return data[at[:, None] + np.arange(width)].reshape(len(at), -1, to).sum(axis=1, dtype=np.int32)


def checked(stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(hub, node, other): pairs of a hub's members that could be similar by their sketches.

    One of such a pair isn't similar to the hub. Members of a hub meet in pairs of blocks, so none
    is compared in one task with all. Where two blocks have more than ``CHECK_PAIRS`` pairs for each
    member, the members come without an other: their differences decide. So do all members of hubs
    of more than ``CHECKED``. What comes out grows with the members, not with their pairs.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sketch = rows["sketch"].to_pylist()
        width = np.array([len(x) for x in sketch])
        data, at = np.frombuffer(b"".join(sketch), dtype=np.uint8), np.cumsum(width) - width
        n, own, block = rows["n"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False), rows["block"].to_numpy()
        within = bool((rows["i"].to_numpy() == rows["j"].to_numpy()).all())
        met, pairs, total = np.zeros(len(width), dtype=bool), [], 0
        for wa in np.unique(width[own]).tolist():
            mine = np.flatnonzero(own & (width == wa))
            for wb in np.unique(width).tolist():
                other = np.flatnonzero(width == wb)
                w = min(wa, wb)
                b = folded(data, at[other], wb, w)
                step = max(1, (1 << 21) // max(1, b.size))
                for k in range(0, len(mine), step):
                    some = mine[k : k + step]
                    a = folded(data, at[some], wa, w)
                    apart = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
                    hit = (apart <= (n[some][:, None] + n[other][None, :]) * (100 - percent) // (100 + percent)) & (some[:, None] != other[None, :])
                    hit &= within | (block[some][:, None] != block[other][None, :])  # pairs of one block meet once
                    met[some[hit.any(axis=1)]] = met[other[hit.any(axis=0)]] = True
                    total += int(hit.sum())
                    if total <= CHECK_PAIRS * len(width):
                        x, y = np.nonzero(hit)
                        pairs.append(np.stack([some[x], other[y]]))
        if total > CHECK_PAIRS * len(width):
            x, y = np.flatnonzero(met), None
        else:
            x, y = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        node = rows["node"].combine_chunks()
        return pa.table({"hub": rows["hub"].take(pa.array(x)), "node": node.take(pa.array(x)), "other": pa.nulls(len(x), pa.int64()) if y is None else node.take(pa.array(y))})

    size = stars.groupBy("hub").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("some").select("hub", "k")
    rows = stars.select("hub", "node", "own", "n").join(size, "hub")
    few = rows.where(f"k <= {CHECKED}").withColumn("blocks", F.ceil(F.col("k") / CHECK_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    few = few.join(sketches.select(F.col("id").alias("node"), "sketch"), "node").withColumn("next", F.explode(F.expr("sequence(0, blocks - 1)")))
    few = few.select("hub", "node", "own", "n", "sketch", "block", F.least("block", "next").alias("i"), F.greatest("block", "next").alias("j"))
    found = few.groupBy("hub", "i", "j").applyInArrow(run, "hub bigint, node bigint, other bigint")
    return found.union(rows.where(f"k > {CHECKED}").select("hub", "node", F.lit(None).cast("bigint")))


def remaining(done: DataFrame, sketches: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the members compared with hubs: pairs (a, b) left to compare, and groups too large for that.

    A pair has a member that isn't similar to the hub, shares one of the rarest shingles, and could
    share enough of all.
    """
    stars = done.where("differ is not null").select(F.col("a").alias("hub"), F.col("b").alias("node"), (~F.col("linked")).alias("own"), F.size("differ").alias("e"), F.col("size_b").alias("n"), "differ")
    near = cut(checked(stars, sketches, percent))
    few = near.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    stars = stars.join(near.where("other is null").select("hub", "node").distinct(), ["hub", "node"], "left_semi")
    tokens = stars.select("hub", "node", "e", "n", F.expr(bound(percent, "n")).alias("h"), "own", F.lit(True).alias("partner"), F.explode("differ").alias("shingle"))
    tokens = cut(prefixed(pruned(pruned(tokens))))
    size = tokens.groupBy("hub", "shingle").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("k > 1 and some").select("hub", "shingle", "k")
    tokens = cut(tokens.join(size, ["hub", "shingle"]))
    side = lambda i: tokens.where(f"k <= {PAIRED}").select("hub", "shingle", *(F.col(c).alias(f"{c}{i}") for c in ("node", "e", "n", "f", "own", "partner")))
    pairs = side(1).join(side(2), ["hub", "shingle"]).where("node1 < node2 and ((own1 and partner2) or (own2 and partner1))")
    pairs = pairs.where(f"e1 + e2 - 2 * least(f1, f2) <= {bound(percent, 'n1', 'n2')}").select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    groups = tokens.where(f"k > {PAIRED}").groupBy(F.xxhash64("hub", "shingle").alias("gid"), "node").agg(F.max("own").alias("own"))
    return cut(pairs.union(few).distinct()), cut(groups)


def candidates(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the rows of MET: the classes (id, h1, h2), the pairs to compare, and the large groups.

    Ids of a node are joined to it here; two classes that share a node become a pair. Frequent
    signatures are left out, then pairs and members that can't share ``common`` of what is left.
    """
    names = found.where("kind = 'name' and doc_id is not null and n_shingles > 0")
    node = F.shiftrightunsigned("h1", 64 - NODE_BITS).alias("node")
    plan = ["own_out", "next_out", "own_common", "next_common"]
    classes = names.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in (*plan, "sketch")])
    classes = cut(classes.select(node, "id", "h1", "h2", "n", *plan, "sketch"))
    large = found.where("kind = 'large'").select("gid", F.col("a").alias("node"), "own", "k").join(classes.select("node", "id", *plan), "node")
    rank = F.row_number().over(Window.partitionBy("id", "own").orderBy(F.col("k").desc(), "gid"))
    large = cut(large.withColumn("i", rank).where("i > if(own, own_out, next_out)").select("gid", "id", "own", F.expr("if(own, own_common, next_common)").alias("common")))
    left = large.groupBy("id", "own").agg(F.count("*").alias("kept"))
    most = left.groupBy("id").agg(F.max("kept").alias("kept"))
    side = lambda k: classes.select(F.col("node").alias(f"node_{k}"), F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("own_common").alias(f"common_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    met_in = lambda k: most.select(F.col("id").alias(k), F.col("kept").alias(f"kept_{k}"))
    pairs = found.where("kind = 'pair'").groupBy(F.col("a").alias("node_a"), F.col("b").alias("node_b")).agg(F.sum("k").alias("k"))
    same = classes.groupBy(F.col("node").alias("node_a")).agg(F.count("*").alias("c")).where("c > 1").select("node_a", F.col("node_a").alias("node_b"), F.lit(1 << 40).alias("k"))
    pairs = pairs.union(same).join(side("a"), "node_a").join(side("b"), "node_b").where(f"(node_a <> node_b or a < b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = pairs.join(met_in("a"), "a", "left").join(met_in("b"), "b", "left").fillna(0, ["kept_a", "kept_b"])
    pairs = cut(pairs.where("k + least(kept_a, kept_b) >= if(n_a > n_b, common_a, common_b)").select("a", "b", "k", "n_a", "n_b", "sketch_a", "sketch_b", F.lit(False).alias("star")))
    times = pairs.select(F.col("a").alias("id"), "k").union(pairs.select("b", "k")).groupBy("id").agg(F.max("k").alias("times"))
    large = large.join(left, ["id", "own"]).join(times, "id", "left").where("kept + coalesce(times, 0) >= common").select("gid", "id", "own")
    size = large.groupBy("gid").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("k > 1 and some").select("gid", "k")
    large = cut(large.join(size, "gid"))
    one, two = (large.where(f"k <= {SMALL}").select("gid", F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    few = one.join(two, "gid").where("a < b and (own_a or own_b)").select("a", "b").distinct()
    sized = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    few = few.join(sized("a"), "a").join(sized("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").withColumn("star", F.lit(False))
    pairs = possible(pairs.drop("k").unionByName(few), percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return classes.select("id", "h1", "h2", "sketch"), cut(pairs), cut(large.where(f"k > {SMALL}").select("gid", F.col("id").alias("node"), "own"))


def hubs_of(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(gid, hub): the member that most groups have, or a heavier hub of its groups that is like it.

    A hub need not be of the group: what it leaves is found by the differences from it. So the
    groups of one cluster mostly get one hub, and a member is compared with few.
    """
    weight = large.groupBy("node").agg(F.sum("k").alias("w"))
    hubs = cut(large.join(weight, "node").groupBy("gid").agg(F.max(F.struct("w", "node")).alias("h")).select("gid", F.col("h.w").alias("w"), F.col("h.node").alias("hub")))
    own = hubs.select(F.col("hub").alias("node")).distinct()
    above = large.join(own, "node", "left_semi").join(hubs, "gid").groupBy("node").agg(F.max(F.struct("w", "hub")).alias("h")).select(F.col("h.hub").alias("a"), F.col("node").alias("b"), F.lit(True).alias("star")).where("a <> b")
    alike = verified(above, sets, percent).where("size(differ) <= (size_a + size_b) / 3").select(F.col("b").alias("hub"), F.col("a").alias("above"))
    return hubs.join(alike, "hub", "left").select("gid", F.coalesce("above", "hub").alias("hub"))


def links(docs: DataFrame, found: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Pairs of class ids (a, b) whose similarity passes: enough of them to connect all similar classes.

    ``found`` is what ``met`` gives. A pair that isn't named is connected through a hub that both are
    similar to.
    """
    classes, left, groups = candidates(found, percent)
    wanted = left.select(F.col("a").alias("id")).union(left.select("b")).union(groups.select("node")).distinct()
    ids = _sent(classes.select("id", "h1", "h2").join(wanted, "id", "left_semi"))
    # documents with a partner: where few, their ids are sent out and the texts stay in place
    picked = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(part.column("text"), n)
        data = kit.binaries(sets.shingle.view(np.uint8), sets.first * 8)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.name), pa.array(sets.name2), pa.array(sets.size, pa.int64()), data], names=["id", "h1", "h2", "size", "shingles"])

    sets = _over(picked, "id bigint, h1 bigint, h2 bigint, size bigint, shingles binary", make, "doc_id", "text")
    sets, out = cut(sets.join(ids, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"])), []
    while True:
        size = groups.groupBy("gid").agg(F.count("*").alias("k"), F.max("own").alias("some")).where("k > 1 and some")
        groups = cut(groups.join(size.drop("some"), "gid"))
        small, large = groups.where(f"k <= {SMALL}"), groups.where(f"k > {SMALL}")
        one, two = small.select("gid", F.col("node").alias("a"), F.col("own").alias("o1")), small.select("gid", F.col("node").alias("b"), F.col("own").alias("o2"))
        near = one.join(two, "gid").where("a < b and (o1 or o2)").select("a", "b", F.lit(False).alias("star"))
        near = near.union(left.select("a", "b", F.lit(False)))
        stars = large.join(hubs_of(large, sets, percent), "gid").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.lit(True).alias("star"))
        done = cut(verified(near.union(stars).groupBy("a", "b").agg(F.max("star").alias("star")), sets, percent))
        out.append(done.where("linked").select("a", "b"))
        if not done.where("differ is not null").limit(1).count():
            break
        left, groups = remaining(done, classes, percent)
    both = out[0]
    for more in out[1:]:
        both = both.union(more)
    return both.distinct()


def clustered(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    with Scratch(prepare(docs.sparkSession)) as scratch:
        found = scratch.written(met(docs, n, percent), "kind")
        names = cut(found.where("kind = 'name'").select("doc_id", "n_shingles", "h1", "h2"))
        roots = components(links(docs, found, n, percent))
    classes = names.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"))
    rooted = classes.join(roots, classes.id == roots.node, "left").select("h1", "h2", "n_shingles", F.coalesce("root", "id").alias("least"))
    out = names.join(rooted, ["h1", "h2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to be joined with: sent to every executor where they are few."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def first_of_each(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the least doc_id, in the columns given.

    Rows with a null doc_id, or without words, are kept; of repeated rows one stays. Texts stay in
    place unless the ids to drop are too many to send; only rows of repeated ids meet.
    """
    rows = clustered(docs, n, percent).where("doc_id is not null")
    ids = cut(rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.bool_or(F.col("component_id") == F.col("doc_id")).alias("first")))
    kept = docs.join(_sent(ids.where("not first").select("doc_id")), "doc_id", "left_anti")
    twice = ids.where("first and k > 1").select("doc_id")
    if twice.limit(1).count():
        twice = _sent(twice)
        once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents"))
