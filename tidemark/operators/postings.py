"""A persisted inverted index in blocks, with upper bounds that let a search skip them.

Words are Unicode letters and digits with ``_`` and ``-``, folded by case and without diacritics. A
*block* holds a term's documents of one range of ids, at most ``BLOCK`` of them, so a term that every
document has is many rows and no group grows with the corpus. Blocks of ``PARTS`` ranges are a *part*,
the unit that is written and replaced: a new generation rewrites the parts with changed documents and
names the older folders for all others, then the pointer moves by one rename.

A search reads the heads of its terms' blocks first (count, greatest frequency, least length), keeps
the ranges that all terms of a query have, and bounds each by the score its best document could have.
The ranges of the greatest bounds are scored first; of the rest only those that could still reach the
k-th score found are read. Postings of a range meet its queries in one place, where the documents of the
rarest term are looked up in the others.

Words are counted where the documents lie, so what is shuffled are postings of many documents each.
The *empty word*, which every document has once, holds their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import folded
from tidemark.session import cut
from tidemark.sources import files

K1, B = 1.2, 0.75
BLOCK, PARTS = 4096, 256
#: Ranges that are scored first for each query, and terms that are pushed to the scan by name.
FIRST, NAMED = 4, 1000
#: Words, or entries of postings, that a task holds at once: about so many.
HELD = 1 << 21
#: Queries of a range that meet its postings in one group, about; and rows that are sent to every task at most.
GROUP, SENT = 64, 200_000
#: Scores are rounded, so a bound may lie a little below the score.
SLACK = 1e-5

# Fixed value: what stands inside a word.
INSIDE = r"[\p{L}\p{N}\p{Co}_-]+"
POSTINGS = "term string, block bigint, n int, most_tf int, least_dl int, docs array<bigint>, tfs array<int>, dls array<int>"
CHUNKS = "term string, block bigint, docs array<bigint>, tfs array<int>, dls array<int>"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(INSIDE), F.lit(0))


def _lists(lengths: np.ndarray, *values: tuple[np.ndarray, pa.DataType]) -> list[pa.ListArray]:
    at = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in values]


def _chunks(docs: DataFrame, block: int) -> DataFrame:
    """Postings of the documents that a task holds at once: (term, block, docs, tfs, dls), in order of doc_id and dl."""

    def count(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, texts = rows["doc_id"].to_numpy(), rows["w"].combine_chunks()
        dl = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        words = texts.flatten().dictionary_encode()
        order = np.lexsort((dl, ids))
        first = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(dl[order]) != 0)][: len(order)]  # rows of one id and length are one document
        place = np.empty(len(ids), np.int64)
        place[order] = np.cumsum(first) - 1
        doc, length = ids[order][first], dl[order][first]
        code = np.r_[words.indices.to_numpy().astype(np.int64), np.full(len(ids), len(words.dictionary))]
        key, tf = np.unique(code * len(doc) + np.r_[np.repeat(place, dl), place], return_counts=True)
        code, place = np.divmod(key, len(doc))
        at = doc[place] // block
        begin = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(at) != 0)])
        terms = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)])
        lists = _lists(np.diff(np.r_[begin, len(key)]), (doc[place], pa.int64()), (tf, pa.int32()), (length[place], pa.int32()))
        return pa.RecordBatch.from_arrays([terms.take(pa.array(code[begin])), pa.array(at[begin]), *lists], names=["term", "block", "docs", "tfs", "dls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("w").flatten())
            if n >= HELD:
                yield count(held)
                held, n = [], 0
        if held:
            yield count(held)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("w"))
    return rows.mapInArrow(run, CHUNKS)


def _joined(chunks: DataFrame) -> DataFrame:
    """One row for each term and block of rows sorted by them; frequencies of a document's rows are added."""

    def join(rows: pa.Table, last: int) -> pa.RecordBatch:
        """The groups of rows; of the last one, which begins at a row, nothing."""
        rows = rows.slice(0, last).combine_chunks()
        term, block = rows["term"].combine_chunks(), rows["block"].to_numpy()
        docs, tfs, dls = (rows[c].combine_chunks() for c in ("docs", "tfs", "dls"))
        new = _new(rows)
        group = np.repeat(np.cumsum(new) - 1, pc.list_value_length(docs).to_numpy(zero_copy_only=False))
        doc, tf, dl = (x.flatten().to_numpy() for x in (docs, tfs, dls))
        differ = lambda: (np.diff(group) != 0, np.diff(doc), np.diff(dl))
        g, d, x = differ()
        if not (g | (d > 0) | ((d == 0) & (x > 0))).all():
            order = np.lexsort((dl, doc, group))
            group, doc, tf, dl = group[order], doc[order], tf[order], dl[order]
            g, d, x = differ()
            once = np.flatnonzero(np.r_[True, g | (d != 0) | (x != 0)])
            group, doc, tf, dl = group[once], doc[once], np.add.reduceat(tf, once), dl[once]
        begin = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        n = np.diff(np.r_[begin, len(group)])
        heads = [pa.array(x, pa.int32()) for x in (n, np.maximum.reduceat(tf, begin), np.minimum.reduceat(dl, begin))]
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([term.take(pa.array(at)), pa.array(block[at]), *heads, *_lists(n, (doc, pa.int64()), (tf, pa.int32()), (dl, pa.int32()))], names=["term", "block", "n", "most_tf", "least_dl", "docs", "tfs", "dls"])

    def _new(rows: pa.Table) -> np.ndarray:
        code = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        return np.r_[True, (np.diff(code) != 0) | (np.diff(rows["block"].to_numpy()) != 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("docs").flatten())
            if n >= HELD:
                rows = pa.Table.from_batches(held)
                if last := int(np.flatnonzero(_new(rows))[-1]):
                    yield join(rows, last)
                held = rows.slice(last).combine_chunks().to_batches()
                n = 0
        if held:
            rows = pa.Table.from_batches(held)
            yield join(rows, rows.num_rows)

    return chunks.mapInArrow(run, POSTINGS)


def _block(block: int) -> Column:
    return F.expr(f"(doc_id - pmod(doc_id, {block})) div {block}")


def _write(chunks: DataFrame, root: str, generation: str, parts: int) -> DataFrame:
    """Write the parts; the manifest rows of them: (part, generation, n, total)."""
    part = F.expr(f"(block - pmod(block, {parts})) div {parts}").alias("part")
    # terms are dealt over tasks, and in order, so that pages can be skipped: the writer's sort by part keeps their order
    dealt = chunks.repartition("term", "block").sortWithinPartitions("term", "block", "docs")
    path = f"{root}/{generation}/postings"
    _joined(dealt).withColumn("part", part).write.mode("errorifexists").partitionBy("part").parquet(path)
    sums = {"n": "aggregate(tfs, 0L, (s, x) -> s + x)", "total": "aggregate(arrays_zip(tfs, dls), 0L, (s, x) -> s + cast(x.tfs as bigint) * x.dls)"}
    lengths = chunks.sparkSession.read.schema(f"{POSTINGS}, part bigint").parquet(path).where("term = ''")
    return lengths.groupBy("part").agg(*[F.sum(F.expr(x)).alias(c) for c, x in sums.items()]).withColumn("generation", F.lit(generation))


def build(docs: DataFrame, root: str, generation: str, block: int = BLOCK, parts: int = PARTS) -> None:
    """Index all documents (doc_id, text) and make this the active generation."""
    made = _write(_chunks(docs, block), root, generation, parts)
    files.publish(made.withColumns({"block": F.lit(block), "parts": F.lit(parts)}), f"{root}/manifests", generation)


def update(changed: DataFrame, removed: DataFrame, root: str, generation: str) -> int:
    """A generation with new and changed documents (doc_id, text), without removed ones (doc_id).

    Only the parts with such documents are rewritten; the number of them is returned.
    """
    index = opened(changed.sparkSession, root)
    block, parts = index.block, index.parts
    gone = cut(changed.select("doc_id").unionByName(removed.select("doc_id")).where("doc_id is not null").distinct())
    touched = [r.part for r in gone.select(_block(block * parts).alias("part")).distinct().collect()]  # parts are few: some million documents each
    old = index.only(touched)
    entries = old.entries().select("term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("e")).select("term", F.col("e.docs").alias("doc_id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
    kept = entries.join(gone, "doc_id", "left_anti").groupBy("term", _block(block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "dl", "tf"))).alias("e"))  # ``block`` at most
    kept = kept.select("term", "block", F.col("e.doc_id").alias("docs"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"))
    made = _write(kept.unionByName(_chunks(changed, block)), root, generation, parts).select("part", "n", "total", "generation")
    others = index.manifest.where(~F.col("part").isin(touched)).select("part", "n", "total", "generation")
    files.publish(others.unionByName(made).withColumns({"block": F.lit(block), "parts": F.lit(parts)}), f"{root}/manifests", generation)
    return len(touched)


class Index(NamedTuple):
    """An opened generation: a row of the manifest for each part."""

    spark: SparkSession
    root: str
    manifest: DataFrame
    places: list[tuple[int, str]]
    n: int
    total: int
    block: int
    parts: int

    def entries(self) -> DataFrame:
        """Postings, those of the empty word too."""
        paths = [f"{self.root}/{g}/postings/part={p}" for p, g in self.places]
        return self.spark.read.schema(POSTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], POSTINGS)

    def postings(self) -> DataFrame:
        return self.entries().where("term <> ''")

    def only(self, parts: list[int]) -> Index:
        return self._replace(places=[(p, g) for p, g in self.places if p in set(parts)])


def opened(spark: SparkSession, root: str) -> Index:
    """The active generation."""
    manifest = files.active(spark, f"{root}/manifests")
    rows = manifest.select("part", "generation", "n", "total", "block", "parts").collect()
    block, parts = (rows[0].block, rows[0].parts) if rows else (BLOCK, PARTS)
    return Index(spark, root, manifest, [(r.part, r.generation) for r in rows], sum(r.n for r in rows), sum(r.total for r in rows), block, parts)


def _few(rows: DataFrame) -> DataFrame:
    """Rows that are joined where the other side lies, unless they are very many."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _scores(ranges: DataFrame, worth: DataFrame, blocks: DataFrame, mean: float) -> DataFrame:
    """(query_id, doc_id, score) of the documents in ranges (query_id, block) that have all terms of the query.

    Queries of a range are dealt over groups; postings go to the groups with queries that have their
    term. Postings come first, so the queries pass them as a stream.
    """
    groups = ranges.groupBy("block").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = ranges.join(groups, "block").select("query_id", "block", F.pmod(F.xxhash64("query_id"), "groups").alias("group"))
    asked = worth.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    asks = cut(dealt.join(asked, "query_id"))
    needs = cut(asks.select("block", "group", F.explode("terms.term").alias("term")).distinct())
    lists = blocks.select("term", "block", "docs", "tfs", "dls").join(_few(needs), ["term", "block"])
    kind = ranges.schema["query_id"].dataType
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    lists = lists.select("block", "group", F.lit(0).alias("kind"), "term", "docs", "tfs", "dls", none(kind, "query_id"), none("array<string>", "terms"), none("array<double>", "idfs"))
    asks = asks.select("block", "group", F.lit(1).alias("kind"), none("string", "term"), none("array<bigint>", "docs"), none("array<int>", "tfs"), none("array<int>", "dls"), "query_id", F.col("terms.term").alias("terms"), F.col("terms.idf").alias("idfs"))
    rows = lists.unionByName(asks).repartition("block", "group").sortWithinPartitions("block", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = {}
        now = None
        for batch in batches:
            docs, tfs, dls = (batch.column(c) for c in ("docs", "tfs", "dls"))
            size = pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(size)]
            doc, tf, dl = (x.flatten().to_numpy() for x in (docs, tfs, dls))
            below = tf + K1 * (1 - B + B * dl / mean)
            again = np.r_[0, np.cumsum(np.r_[False, np.diff(doc) == 0])]  # equal neighbours up to an entry
            places, terms, idfs = (batch.column(c).to_pylist() for c in ("block", "group", "kind")), batch.column("terms"), batch.column("idfs")
            hits = []
            for i, (block, group, asks, term) in enumerate(zip(*places, batch.column("term").to_pylist(), strict=True)):
                if now != (block, group):
                    held, now = {}, (block, group)
                s, e = at[i], at[i + 1]
                if not asks:
                    held[term] = doc[s:e], tf[s:e], below[s:e], bool(again[e] > again[s + 1])
                else:  # a range that is asked has all terms
                    lists = zip([held[t] for t in terms[i].as_py()], idfs[i].as_py(), strict=True)
                    hits.append((i, *_all(sorted(lists, key=lambda x: len(x[0][0])))))
            hits = [h for h in hits if len(h[1])]
            if hits:
                queries = batch.column("query_id").take(pa.array(np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])))
                yield pa.RecordBatch.from_arrays([queries, pa.array(np.concatenate([h[1] for h in hits])), pa.array(np.concatenate([h[2] for h in hits]))], names=["query_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"query_id {kind.simpleString()}, doc_id bigint, score double").withColumn("score", F.round("score", 6))


def _all(lists: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray, bool], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are in all postings, shortest first, and their scores."""
    if any(again for (*_, again), _ in lists):  # an id of several lengths: entries are counted
        found, at, met = np.unique(np.concatenate([p[0] for p, _ in lists]), return_inverse=True, return_counts=True)
        score = np.bincount(at, np.concatenate([idf * p[1] * (K1 + 1) / p[2] for p, idf in lists]), len(found))
        return found[met == len(lists)], score[met == len(lists)]
    found = lists[0][0][0]
    for (doc, *_), _ in lists[1:]:
        at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
        found = found[doc[at] == found]
        if not len(found):
            break
    score = np.zeros(len(found))
    for (doc, tf, below, _), idf in lists:
        at = np.searchsorted(doc, found)
        score += idf * tf[at] * (K1 + 1) / below[at]
    return found, score


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank) of queries (query_id, text), and what was read for them.

    A document must have all words of a query; queries without words find nothing. The second result
    has a row of counts: blocks of the terms, those in ranges that all terms have, and those scored.
    """
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")))
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    wanted = cut(terms.select("term").distinct())
    named = [r.term for r in wanted.limit(NAMED + 1).collect()]
    blocks = index.postings()
    blocks = blocks.where(F.col("term").isin(named)) if len(named) <= NAMED else blocks.join(_few(wanted), "term", "left_semi")
    mean = index.total / index.n if index.total else 1.0
    heads = cut(blocks.select("term", "block", "n", "most_tf", "least_dl"))
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = cut(terms.join(df, "term").join(need, "query_id").select("query_id", "term", "need", idf.alias("idf")))
    bound = F.col("idf") * F.col("most_tf") * (K1 + 1) / (F.col("most_tf") + K1 * (1 - B + B * F.col("least_dl") / mean))
    # only the ranges of a query's rarest term can have all its terms
    rarest = terms.join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    ranges = heads.join(rarest, "term").select("query_id", "block")
    bounded = ranges.join(worth, "query_id").join(heads, ["term", "block"]).groupBy("query_id", "block", "need").agg(F.sum(bound).alias("bound"), F.count("*").alias("met")).where("met = need")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounded = cut(bounded.select("query_id", "block", "bound"))
    early = cut(bounded.withColumn("place", place).where(F.col("place") <= first).drop("place"))
    scores = lambda some: _scores(some.select("query_id", "block"), worth, blocks, mean)
    found = cut(_top(scores(early), k))
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    late = bounded.join(early.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    late = cut(late.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "block", "bound"))
    hits = _top(found.drop("rank").unionByName(scores(late)), k)
    counts = heads.agg(F.count("*").alias("blocks")).join(bounded.agg(F.count("*").alias("ranges")).join(early.unionByName(late).agg(F.count("*").alias("scored"))))
    return hits, counts


def skipped(counts: DataFrame) -> float:
    """The share of ranges with all terms that were not read."""
    r = counts.first()
    return 0.0 if not r.ranges else 1 - r.scored / r.ranges

