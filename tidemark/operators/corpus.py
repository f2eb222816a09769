"""Documents: chunks, postings, BM25, fusion, exact and near duplicates, leakage-free splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import components
from tidemark.session import cut, stored

K1, B = 1.2, 0.75
#: Ids that are sent to every task at most.
SENT = 1_000_000
#: Cells of hashes of shingles that are counted, and of those in a row while they are added: powers of two.
CELLS, SLICE = 1 << 20, 1 << 12


def tokens(text: str) -> str:
    return f"filter(split(lower({text}), '[\\\\s.,!?|]+'), w -> w <> '')"


def those(rows: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows whose id is among some: they are filtered where they lie, unless the ids are very many."""
    ids = cut(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, name, "left_semi")


def chunks(docs: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """(doc_id, chunk, text): runs of words, each beginning ``size - overlap`` after the one before."""
    step = size - overlap
    words = docs.select("doc_id", F.expr("filter(split(text, '[ \\n]+'), w -> w <> '')").alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(0, cast(ceil((size(w) - {size}) / {step}) as int)))")
    return words.select("doc_id", "w", F.explode(starts).alias("chunk")).select("doc_id", "chunk", F.expr(f"array_join(slice(w, chunk * {step} + 1, {size}), ' ')").alias("text"))


def _bm25_by_postings(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``bm25`` where ids repeat: rows of one id and length are one document.

    Only postings of query terms are shuffled; document lengths ride along with the postings. As all
    terms must be met, only documents with a query's rarest term are scored for it.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    split = docs.select("doc_id", F.expr(tokens("text")).alias("w"))
    stats = split.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    posts = split.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    tf = posts.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    asked = tf.select("term", "doc_id").distinct().join(rarest, "term").select("query_id", "doc_id")
    hits = asked.join(terms, "query_id").join(tf, ["term", "doc_id"]).join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("met")).join(wanted, "query_id").where("met = need")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.select("query_id", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents with all distinct terms of a query.

    Documents are counted by term first. Then each document with a query's rarest term is held against all
    its terms where it lies, so only frequencies of documents with all terms are shuffled.
    """
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _bm25_by_postings(docs, queries, k)
    terms = queries.select("query_id", F.array_distinct("terms").alias("terms")).where("size(terms) > 0")
    term = terms.select("query_id", F.explode("terms").alias("term"))
    split = docs.select("doc_id", F.expr(tokens("text")).alias("w"))
    # one pass counts documents by term and, as those of the empty word that no text has, all of them and their words
    seen = split.select(F.size("w").alias("dl"), F.explode(F.coalesce(F.array_append(F.array_distinct("w"), F.lit("")), F.array(F.lit("")))).alias("term"))
    wanted = term.select("term").union(docs.sparkSession.sql("select ''")).distinct()
    counts = cut(seen.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"), F.count("dl").alias("known")))
    df, stats = counts.where("term <> ''").select("term", "df"), counts.where("term = ''").select(F.col("df").alias("n"), (F.col("total") / F.col("known")).alias("mean"))
    rarest = term.join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    asked = terms.join(rarest, "query_id")
    near = split.where("doc_id is not null").select("doc_id", "w", F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(asked), "term").where(F.size(F.array_except("terms", "w")) == 0)
    tfs = F.transform("terms", lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))
    hits = near.select("query_id", "doc_id", F.size("w").alias("dl"), F.explode(tfs).alias("e")).select("query_id", "doc_id", "dl", "e.*").join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.select("query_id", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """Full outer fusion of two rankings (query_id, doc_id, score, rank)."""
    a = dense.select("query_id", "doc_id", F.col("score").alias("semantic"), F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "doc_id", F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    fused = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("lexical_rank")), F.lit(0.0))
    return both.withColumn("fused", F.round(fused, 9))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): each document with the least document of the same normalised text; those without a text are alike."""
    text = F.trim(F.regexp_replace(F.lower("text"), "[\\s.,!?|]+", " "))
    keyed = docs.select("doc_id", F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("h"))
    least = keyed.groupBy("h").agg(F.min("doc_id").alias("kept"))
    return keyed.join(least, "h").select("doc_id", "kept")


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles fall into each of ``CELLS`` cells of their hashes: a vector of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("s").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        parts = total.reshape(-1, min(CELLS, SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n"), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(n.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["part", "n"])

    kind = "part bigint, n binary"
    counts = np.zeros((-(-CELLS // SLICE), min(CELLS, SLICE)), np.int64)
    for r in sets.select("s").mapInArrow(run, kind).repartition("part").mapInArrow(added, kind).collect():
        counts[r.part] = np.frombuffer(r.n, np.int64)
    return counts.ravel()


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, doc_id, m, p): a hash of each set, and its first shingles, those of the least counted cells first."""
    sent = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = batch.column("s").flatten().to_numpy(), batch.column("m").to_numpy().astype(np.int64)
            row, ends = np.repeat(np.arange(len(m)), m), np.cumsum(m)
            x = x[np.lexsort((x, row))]
            whole = [hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip((ends - m).tolist(), ends.tolist(), strict=True)]
            order = np.lexsort((sent.value[x & (CELLS - 1)], row))
            keep = m - np.ceil(threshold * m - 1e-9).astype(np.int64) + 1
            place = np.arange(len(x)) - np.repeat(ends - m, m)
            first = x[order][place < np.repeat(keep, m)]
            p = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), batch.column("doc_id"), batch.column("m"), p], names=["h", "doc_id", "m", "p"])

    return sets.mapInArrow(run, "h binary, doc_id bigint, m int, p array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, m, s): the distinct shingles of each document that has any, and their number."""
    w = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(tokens("text")).alias("w")).where(f"size(w) >= {n}")
    gram = ", ".join(f"get(w, i + {j})" for j in range(n))
    sets = w.select("doc_id", F.expr(f"array_distinct(transform(sequence(0, size(w) - {n}), i -> xxhash64({gram})))").alias("s"))
    return stored(sets.select("doc_id", F.size("s").alias("m"), "s"))


def _near(sets: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the least documents of unlike sets that pass."""
    # equal sets, as those of exact copies, are one: the least document stands for it
    first = prefixes.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("m").alias("m"), F.first("p").alias("p"))
    first = cut(first.select("doc_id", "m", F.posexplode("p").alias("i", "x")).withColumn("i", F.col("i") + 1))
    one, two = first.select("x", F.col("doc_id").alias("a"), F.col("m").alias("ma"), F.col("i").alias("ia")), first.select("x", F.col("doc_id").alias("b"), F.col("m").alias("mb"), F.col("i").alias("ib"))
    # sets of too different sizes can't pass, nor those of which too little is left from their first meeting on
    first_met = one.join(two, "x").where(f"a < b and least(ma, mb) >= {threshold}D * greatest(ma, mb)").groupBy("a", "b", "ma", "mb").agg(F.min("ia").alias("ia"), F.min("ib").alias("ib"))
    near = cut(first_met.where(f"least(ma - ia, mb - ib) + 1 >= {threshold / (1 + threshold)}D * (ma + mb) - 1e-6").select("a", "b", "ma", "mb"))
    some = those(sets.select("doc_id", "s"), near.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = near.join(some.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", "ma", "mb", F.size(F.array_intersect("sa", "sb")).alias("k"))
    return shared.select("a", "b", F.expr("k / cast(ma + mb - k as double)").alias("jaccard")).where(f"jaccard >= {threshold}D")


def shingle_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.9) -> DataFrame:
    """(a, b, jaccard) of distinct texts whose shingle sets pass, by prefixes.

    Two sets at the threshold share one of their first ``size - ceil(threshold * size) + 1``
    shingles in a common order. Any order will do; here shingles of cells with few come first, so
    such prefixes meet seldom, and only they and the sets of documents that met are shuffled.
    Of documents of one set only the least is in pairs.
    """
    sets = _sets(docs, n)
    return _near(sets, _prefixes(sets, threshold), threshold)


def duplicate_clusters(docs: DataFrame, n: int = 5, threshold: float = 0.9) -> DataFrame:
    """(doc_id, cluster): exact copies and near ones together, named by their least document.

    Unlike texts may have one set, as those that repeat a passage another number of times: they are
    one by their set, and its least document is linked with others for all of them.
    """
    exact, sets = exact_duplicates(docs), _sets(docs, n)
    prefixes = stored(_prefixes(sets, threshold))
    roots = components(_near(sets, prefixes, threshold).select("a", "b")).withColumnRenamed("node", "least")
    same = prefixes.select("h", "doc_id").join(prefixes.groupBy("h").agg(F.min("doc_id").alias("least")), "h").where("doc_id <> least")
    same = same.groupBy(F.col("doc_id").alias("kept")).agg(F.min("least").alias("first"))
    linked = exact.join(same, "kept", "left").withColumn("least", F.coalesce("first", "kept"))
    return linked.join(roots, "least", "left").select("doc_id", F.coalesce("root", "least").alias("cluster"))


def grouped_hash_split(groups: DataFrame, key: str, ratios: tuple[tuple[str, int], ...] = (("train", 70), ("validation", 15), ("test", 15))) -> DataFrame:
    """(key, split): whole groups by the order of their hash, so related rows never part."""
    point = F.conv(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 100
    out, top = F.lit(ratios[-1][0]), sum(r for _, r in ratios[:-1])
    for name, share in reversed(ratios[:-1]):
        out = F.when(point < top, name).otherwise(out)
        top -= share
    return groups.select(key).distinct().select(key, out.alias("split"))
