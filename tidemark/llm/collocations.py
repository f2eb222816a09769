"""Phrase collocation mining by hierarchical pair naming.

Texts become *blocks*: for a slab and language, its distinct words and the sequence of their places,
with a break between pieces. Words that are frequent in their language get ids, dense numbers given
once for the whole corpus. Then level by level: adjacent ids of (k-1)-grams are counted as pairs,
frequent pairs get ids of their own, and the ids replace the pairs in all sequences, so the id of a
k-gram stands where the k-gram starts. As every part of a frequent phrase is frequent, no phrase is
lost. The pair of an id points to its two parents, and those to theirs: counts of all first and last
words of a phrase and all candidates inside it are found by joins on ids, never by texts.

A block sends each distinct pair once, with its count, so a pair that stands everywhere gives a row
for each group of blocks. Names go to all executors if they are few; beyond that, blocks meet only the
names of pairs they have.

Counts are exact; scores are whole numbers computed in decimals of 38 digits. Edge cases: null and empty
texts give no word; rows without ``lang`` are of language ``und``; repeated rows count each; a very long
text is a slab by itself; ties of score and count go by the phrase's UTF-8 bytes; an empty table
gives an empty result; other columns (doc_id too) are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.operators.order import positioned
from tidemark.session import Scratch, cut, prepare, table

LEAST, LONGEST, COVER, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Names that are sent to every executor at most (24 bytes for a pair, a few words for a word).
SENT = 400_000
#: Distinct pairs that a task adds up before it sends them; ids with which a pair fits one number.
GATHERED, ONE_NUMBER = 1 << 21, 3_000_000_000
NO_LANG = "und"

SEPARATORS = ~kit.table_of([(0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x0A, 0x0D)])
INSIDE = kit.table_of([(0x20, 0x20), (0x09, 0x09)]) & ~SEPARATORS

BLOCKS = "lang string, words array<string>, counts array<bigint>, ids binary"


def _distinct_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and which of these each word is; hashes are verified by bytes."""
    _, first, which = np.unique(kit.byte_hash(buf, start, end), return_index=True, return_inverse=True)
    if kit.same_bytes(buf, start, end, first[which]).all():
        return first, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(buf[s:e].tobytes(), len(seen)) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


def _gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(start, size)
    return kit.binaries(buf[at], bounds).cast(pa.string())


def blocks_of(docs: DataFrame) -> DataFrame:
    """A row for each slab and language: distinct words, their counts, and the sequence of their places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                buf, offsets = kit.raw(part.column("text"))
                start, end = kit.runs(INSIDE[buf], offsets)
                if not len(start):
                    continue
                marks = np.concatenate([[0], np.cumsum(SEPARATORS[buf])])
                row = np.searchsorted(offsets, start, side="right") - 1
                broken = np.zeros(len(start), dtype=bool)  # before the word
                broken[1:] = (row[1:] != row[:-1]) | (marks[start[1:]] != marks[end[:-1]])
                buf = kit.FOLD[buf]
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])[row]
                for i, lang in enumerate(names):
                    some = np.flatnonzero(code == i)
                    if not len(some):
                        continue
                    first, which = _distinct_words(buf, start[some], end[some])
                    apart = broken[some].copy()
                    apart[1:] |= np.diff(some) > 1
                    apart[0] = False
                    ids = np.full(len(some) + int(apart.sum()), -1, dtype=np.int32)
                    ids[np.arange(len(some)) + np.cumsum(apart)] = which
                    words = _gathered(buf, start[some][first], end[some][first])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(which, minlength=len(first)).tolist()], pa.list_(pa.int64())), pa.array([kit.blob(ids)], pa.binary())],
                        names=["lang", "words", "counts", "ids"],
                    )

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(each, BLOCKS)
    return rows.withColumn("block", F.monotonically_increasing_id())


def ids_of(names: int) -> np.dtype:
    """The width of ids, of which there are so many."""
    return np.dtype(np.int32 if names < 1 << 31 else np.int64)


def trimmed(ids: np.ndarray) -> np.ndarray:
    """The ids with one break for each run of places without one: only neighbours matter."""
    out = ids >= 0
    stay = out.copy()
    stay[1:] |= out[:-1]
    return ids[stay]


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct adjacent pairs (left, right, count), the places where pairs start, and the pair of each."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    own, code = np.unique(ids, return_inverse=True)
    both, which, n = np.unique(code[at] * len(own) + code[at + 1], return_inverse=True, return_counts=True)
    return own[both // len(own)], own[both % len(own)], n, at, which


def _named(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Frequent keys with their counts and an id, a place in the order of the keys."""
    return cut(positioned(pairs.where(F.col("f") >= least), keys, "id"))


def counted_pairs(blocks: DataFrame, names: int) -> DataFrame:
    """(l, r, n): adjacent ids of all blocks; a task adds up the pairs of many blocks first.

    A pair travels as one number where ids are few enough for that, and as two beyond. What a task
    sends is combined already, so rows are dealt before Spark adds them up.
    """
    kind, one = ids_of(names), names <= ONE_NUMBER

    def added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        *keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort(keys[::-1])
        keys, n = [k[order] for k in keys], n[order]
        new = np.ones(len(n), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        begin = np.flatnonzero(new)
        return *(k[begin] for k in keys), np.add.reduceat(n, begin) if len(begin) else n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        sent = lambda part: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["key", "n"] if one else ["l", "r", "n"])
        for batch in batches:
            for data in batch.column("ids"):
                l, r, n = pairs_of(np.frombuffer(data.as_buffer(), dtype=kind))[:3]
                l, r = l.astype(np.int64), r.astype(np.int64)
                held.append((l * names + r, n) if one else (l, r, n))
                size += len(n)
                if size > GATHERED:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield sent(held[0])
                        held, size = [], 0
        if held:
            yield sent(added(held))

    if not one:
        rows = blocks.select("ids").mapInArrow(each, "l bigint, r bigint, n bigint")
        return rows.repartition("l", "r").groupBy("l", "r").agg(F.sum("n").alias("n"))
    summed = blocks.select("ids").mapInArrow(each, "key bigint, n bigint").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.select(F.expr(f"key div {max(names, 1)}").alias("l"), (F.col("key") % max(names, 1)).alias("r"), "n")


class PairNames:
    """Names of few pairs, for lookups in a block."""

    def __init__(self, rows: pa.Table) -> None:
        l, r, self.id = (rows.column(x).to_numpy() for x in ("l", "r", "id"))
        self.own = np.unique(np.concatenate([l, r]))
        code = np.searchsorted(self.own, l) * len(self.own) + np.searchsorted(self.own, r)
        order = np.argsort(code)
        self.code, self.id = code[order], self.id[order]

    def of(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The ids of pairs, -1 for one without a name."""
        if not len(self.id):
            return np.full(len(l), -1, dtype=np.int64)
        a, b = (np.minimum(np.searchsorted(self.own, x), len(self.own) - 1) for x in (l, r))
        code = a * len(self.own) + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.own[a] == l) & (self.own[b] == r) & (self.code[at] == code), self.id[at], -1)


def _one(block: int, ids: np.ndarray, kind: np.dtype) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kit.blob(trimmed(ids).astype(kind))], pa.binary())], names=["block", "ids"])


RENAMED = "block bigint, ids binary"
Renamed = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]


def _looked_up(blocks: DataFrame, found: DataFrame, renamed: Renamed) -> DataFrame:
    """``renamed`` of each block and of the names, by place, of what is distinct in it; these meet by block."""

    def run(rows: pa.Table, names: pa.Table) -> pa.Table:
        parts = [batch.slice(i, 1) for batch in rows.combine_chunks().to_batches() for i in range(batch.num_rows)]
        out = [renamed(part, names.column("place").to_numpy(), names.column("id").to_numpy()) for part in parts]
        return pa.Table.from_batches(out, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary())]))

    by = blocks.select("block", "ids").groupBy("block")
    return by.cogroup(found.select(F.col("block").alias("of"), "place", "id").groupBy("of")).applyInArrow(run, RENAMED)


def with_words_named(blocks: DataFrame, names: DataFrame, n: int, sent_most: int) -> DataFrame:
    """The sequences with the n ids of frequent words for places of words."""
    kind = ids_of(n)

    def renamed(part: pa.RecordBatch, place: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        seq = np.frombuffer(part.column("ids")[0].as_buffer(), dtype=np.int32)
        by = np.full(int(seq.max(initial=-1)) + 2, -1, dtype=np.int64)  # the last for breaks
        by[place] = ids
        return _one(part.column("block")[0].as_py(), by[seq], kind)

    if n > sent_most:
        words = blocks.select("block", "lang", F.posexplode("words").alias("place", "word")).join(names, ["lang", "word"])
        return _looked_up(blocks, words, renamed)
    dictionary: dict[str, dict[str, int]] = {}
    for r in names.select("lang", "word", "id").collect():
        dictionary.setdefault(r.lang, {})[r.word] = r.id
    sent = blocks.sparkSession.sparkContext.broadcast(dictionary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                known = sent.value.get(part.column("lang")[0].as_py(), {})
                ids = np.array([known.get(w, -1) for w in part.column("words")[0].as_py()], dtype=np.int64)
                yield renamed(part, np.arange(len(ids)), ids)

    return blocks.select("block", "lang", "words", "ids").mapInArrow(each, RENAMED)


def with_pairs_named(blocks: DataFrame, shorter: int, names: DataFrame, n: int, sent_most: int) -> DataFrame:
    """The sequences with the n ids of frequent pairs for the left one, one of ``shorter`` ids, of each pair."""
    old, kind = ids_of(shorter), ids_of(n)

    def renamed(part: pa.RecordBatch, place: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        seq = np.frombuffer(part.column("ids")[0].as_buffer(), dtype=old)
        left, _, _, at, which = pairs_of(seq)
        by = np.full(len(left), -1, dtype=np.int64)
        by[place] = ids
        out = np.full(len(seq), -1, dtype=np.int64)
        out[at] = by[which]
        return _one(part.column("block")[0].as_py(), out, kind)

    def distinct(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return pairs_of(np.frombuffer(part.column("ids")[0].as_buffer(), dtype=old))[:2]

    if n > sent_most:

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    l, r = distinct(batch.slice(i, 1))
                    block = np.full(len(l), batch.column("block")[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block, np.arange(len(l)), l, r)], names=["block", "place", "l", "r"])

        return _looked_up(blocks, blocks.mapInArrow(pairs, "block bigint, place bigint, l bigint, r bigint").join(names, ["l", "r"]), renamed)
    sent = blocks.sparkSession.sparkContext.broadcast(PairNames(names.select("l", "r", "id").toArrow()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                l, r = distinct(part)
                yield renamed(part, np.arange(len(l)), sent.value.of(l, r))

    return blocks.mapInArrow(each, RENAMED)


def phrases(pairs: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Named pairs as phrases of k words, with what their parents know.

    ``firsts`` and ``lasts`` are the counts of the first and last 1, 2, ... words; ``inner`` are the
    candidates inside, as (words, id).
    """
    p = shorter.select(F.col("id").alias("l"), "lang", "words", "firsts", F.col("inner").alias("inner_l"))
    q = shorter.select(F.col("id").alias("r"), F.element_at("words", -1).alias("last"), "lasts", F.col("inner").alias("inner_r"))
    parent = lambda side: F.struct(F.lit(k - 1).alias("words"), F.col(side).alias("id"))
    inner = F.array_distinct(F.concat("inner_l", "inner_r", F.array(parent("l"), parent("r")))) if k > 2 else F.col("inner_l")
    return pairs.join(p, "l").join(q, "r").select(
        "id", "lang", F.concat("words", F.array("last")).alias("words"), "f", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"), inner.alias("inner")
    )


def lowest_cut(scale: int) -> Column:
    """The cut with the least score, the first of such: (score, k, l, r)."""
    n = F.size("words")
    places = F.sequence(F.lit(1), n - 1)

    def cut_at(k: Column) -> Column:
        l, r = F.element_at("firsts", k), F.element_at("lasts", n - k)
        score = F.call_function("div", F.col("f").cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)"), (l.cast("decimal(19,0)") + r.cast("decimal(19,0)")))
        return F.struct(score.cast("bigint").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(places, cut_at))


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, sent_most: int = SENT) -> DataFrame:
    """Per language its ``top`` collocations: lang, rank, phrase, a, l, r, n and score.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times; those inside a longer
    one that has ``cover`` percent of their count are dropped.
    """
    spark = prepare(docs.sparkSession)
    with Scratch(spark) as scratch:

        def written(rows: DataFrame) -> DataFrame:
            path = f"{scratch.top}/{uuid.uuid4().hex}"
            rows.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        blocks = written(blocks_of(docs))
        sizes = cut(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")))
        each = blocks.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("x")).select("lang", "x.word", "x.n")
        names = _named(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), ["lang", "word"], least)
        n = names.count()
        nothing = F.expr("cast(array() as array<struct<words:int,id:bigint>>)")
        level = names.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"), nothing.alias("inner"))
        levels, sequences = [], with_words_named(blocks, names, n, sent_most)
        for k in range(2, longest + 1):
            sequences = written(sequences)
            pairs = _named(counted_pairs(sequences, n).withColumnRenamed("n", "f"), ["l", "r"], least)
            level = cut(phrases(pairs, level, k))
            levels.append(level.withColumn("k", F.lit(k)))
            if k < longest:
                shorter, n = n, pairs.count()
                sequences = with_pairs_named(sequences, shorter, pairs, n, sent_most)
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        longer = found.select(F.explode("inner").alias("x"), "f").groupBy(F.col("x.words").alias("k"), F.col("x.id").alias("id")).agg(F.max("f").alias("longer"))
        left = found.join(longer, ["k", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
        scored = left.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), lowest_cut(SCALE).alias("cut"))
        order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
        first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = first.join(F.broadcast(sizes), "lang") if sizes.count() <= sent_most else first.join(sizes, "lang")
        return cut(out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents").select("lang", "text"))
