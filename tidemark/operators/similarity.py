"""Similarity search: robust profiles by cohort, masked weighted distances, cosine top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP, EPSILON = 8.0, 1e-9
#: Vectors in a block of rows and in one of queries: a product of two blocks bounds a worker's memory.
ASKED, MASKED_ROWS = 256, 4096
#: Parts that rows are dealt over, asked vectors of a group (about), and of those in one product with an Arrow batch of rows.
DEALT, GROUP, AT_ONCE = 32, 16384, 1024
#: Tasks that the blocks of one kind are dealt over where they meet queries.
SALT = 16


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")


def norm(v: str) -> Column:
    """Length of an array; zero counts as one."""
    return F.expr(f"if(aggregate({v}, 0D, (s, x) -> s + x * x) = 0, 1D, sqrt(aggregate({v}, 0D, (s, x) -> s + x * x)))")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays; a zero norm counts as one."""
    return dot(a, b) / (norm(a) * norm(b))


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _finite(v: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles; nulls are NaN."""
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(v), len(flat) // len(v))


def met(rows: DataFrame, key: list[str], k: int, tasks: int, unit: bool = False) -> DataFrame:
    """(query_id, doc_id, score): for each asked vector of a group, the k rows of the group most like it, itself left out.

    ``rows`` are (key, kind, id, v), ``kind`` 0 for asked ones and 1 for rows, all of a group of one
    dimension; ``unit`` tells that they have length one. A group is a stream: its asked vectors come
    first and are held, rows follow an Arrow batch at a time in the order of their ids, so a later one
    takes a place only if it is more like, and k places for each asked vector are all that is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, q, mine, best, found = None, [], np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((0, k)), np.zeros((0, k), np.int64)

        def result() -> pa.RecordBatch:
            a, b = np.nonzero(np.isfinite(best))
            return pa.RecordBatch.from_arrays([pa.array(mine[a]), pa.array(found[a, b]), pa.array(best[a, b])], names=["query_id", "doc_id", "score"])

        def compare(ids: np.ndarray, e: np.ndarray) -> None:
            for at in range(0, len(q), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                score = np.round(q[some] @ e.T, 6) + 0.0
                score[(mine[some, None] == ids[None, :]) | np.isnan(score)] = -np.inf
                better = at + np.flatnonzero(score.max(axis=1) > best[some].min(axis=1))
                both = np.concatenate([best[better], score[better - at]], axis=1)
                last = np.partition(both, len(ids), axis=1)[:, len(ids), None]
                over, tie = both > last, both == last
                row, place = np.nonzero(over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True))))
                names = np.where(place < k, found[better[row], np.minimum(place, k - 1)], ids[np.maximum(place - k, 0)])
                best[better], found[better] = both[row, place].reshape(-1, k), names.reshape(-1, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in [*key, "kind"]])
            begin = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(begin, begin[1:], strict=False):
                ids, e = batch.column("id").slice(a, b - a).to_numpy(), _finite(batch.column("v").slice(a, b - a))
                if not unit:
                    n = np.sqrt((e * e).sum(axis=1, keepdims=True))
                    e /= np.where(n == 0, 1, n)
                if group != (now := tuple(marks[:-1, a].tolist())):
                    yield result()
                    group, held, q, mine, best = now, [], q[:0], mine[:0], best[:0]
                if marks[-1, a] == 0:
                    held.append((ids, e))
                    continue
                if held:
                    mine, q = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, best, found = [], np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
                compare(ids, e)
        yield result()

    dealt = rows.repartition(tasks, *key).sortWithinPartitions(*key, "kind", "id")
    return dealt.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows (id, v) most like each asked one, itself left out.

    The cosine is rounded to six digits, ties go to the lesser id; a zero vector is like nothing (0);
    rows without id or vector are neither found nor asked. Every row is compared: rows are dealt over
    ``DEALT`` parts, asked ones into groups of about ``GROUP``, and each part meets each group as a stream.
    """
    kind = "array<float>" if all(df.schema["v"].dataType.simpleString() == "array<float>" for df in (rows, asked)) else "array<double>"
    clean = lambda df: df.where("id is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), F.col("v").cast(kind).alias("v"))
    groups = -(-max(asked.count(), 1) // GROUP)
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = clean(rows).select(F.size("v").alias("dims"), part(DEALT, 0).alias("salt"), each(groups).alias("group"), F.lit(1).alias("kind"), "id", "v")
    here = clean(asked).select(F.size("v").alias("dims"), each(DEALT).alias("salt"), part(groups, 1).alias("group"), F.lit(0).alias("kind"), "id", "v")
    found = met(there.unionByName(here), ["dims", "salt", "group"], k, DEALT * groups)
    return top_k(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def dealt(rows: DataFrame, asked: DataFrame, by: str, id: str) -> DataFrame:
    """Rows with the asked ones of the same ``by``; the rows of one value meet them in ``SALT`` tasks."""
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(id), F.lit(SALT)))
    return salted.join(asked.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint")))), [by, "salt_"]).drop("salt_")


def _padded(v: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of doubles as a matrix of ``dims`` columns, and where they have a value."""
    v = pa.array(v.to_pylist(), v.type) if v.offset else v
    values, starts = v.values, v.offsets.to_numpy()
    sizes = np.diff(starts)
    row, at = np.repeat(np.arange(len(v)), sizes), np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], sizes)
    values = values.slice(starts[0], starts[-1] - starts[0])
    e, known = np.zeros((len(v), dims)), np.zeros((len(v), dims), dtype=bool)
    e[row, at] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    known[row, at] = values.is_valid().to_numpy(zero_copy_only=False)
    return e, known


def _masked_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(by, ids, prefers, data, known, sizes, dims): rows (by, id, prefer, v) in blocks of one ``by``, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[pa.Table]] = {}

        def block(by: object) -> pa.RecordBatch:
            part = pa.concat_tables(held.pop(by)).sort_by([("prefer", "ascending"), ("id", "ascending")]).combine_chunks()
            v = part["v"].combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            sizes = np.diff(v.offsets.to_numpy()).astype(np.int64)
            e, known = _padded(v, max(int(sizes.max()), 1))
            blobs = [part["id"].to_numpy().tobytes(), part["prefer"].to_numpy().tobytes(), e.tobytes(), known.tobytes(), sizes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([by], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs], pa.array([e.shape[1]], pa.int32())], names=["by", "ids", "prefers", "data", "known", "sizes", "dims"])

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for by in whole["by"].unique().to_pylist():
                held.setdefault(by, []).append(whole.filter(pc.equal(whole["by"], by)))
                if sum(t.num_rows for t in held[by]) >= size:
                    yield block(by)
        for by in list(held):
            yield block(by)

    cast = [F.col("by").cast("bigint").alias("by"), F.col("id").cast("bigint").alias("id"), F.col("prefer").cast("bigint").alias("prefer"), F.col("v").cast("array<double>").alias("v")]
    whole = rows.select(*cast).where("by is not null and id is not null and prefer is not null and v is not null")
    return whole.mapInArrow(run, "by bigint, ids binary, prefers binary, data binary, known binary, sizes binary, dims int")


def masked_nearest(rows: DataFrame, asked: DataFrame, k: int, least: int = 8, weights: Callable[[np.ndarray], np.ndarray] | None = None, apart: bool = False) -> DataFrame:
    """(query_id, id, prefer, d, distance, rank): the k rows (by, id, prefer, v) nearest to each asked (by, id, v) of the same ``by``.

    ``d`` is ``masked_distance`` from the asked one, ``distance`` is it rounded to six digits, by which
    rows are told, then by the lesser ``prefer`` and id; ``apart`` leaves a row of the asked id out.
    Every row is compared: blocks of rows meet blocks of queries, squares are added dimension by
    dimension (so sums are those of a fold over the arrays), and k rows for each query leave a block.
    ``weights`` maps the numbers of dimensions to their weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, prefers, mine, sizes = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "prefers", "asked_ids", "asked_sizes"))
                e, q = np.frombuffer(r["data"]).reshape(len(ids), -1), np.frombuffer(r["asked_data"]).reshape(len(mine), -1)
                m, n = np.frombuffer(r["known"], dtype=bool).reshape(e.shape), np.frombuffer(r["asked_known"], dtype=bool).reshape(q.shape)
                shared = min(e.shape[1], q.shape[1])
                weight = weights(np.arange(shared)).astype(np.float64) if weights else np.ones(shared)
                squares, total, both = (np.zeros((len(mine), len(ids))) for _ in range(3))
                for i, (x, known) in enumerate(zip(np.ascontiguousarray(e.T[:shared]), np.ascontiguousarray(m.T[:shared]), strict=True)):
                    seen = n[:, i, None] & known[None, :]
                    off = q[:, i, None] - x[None, :]
                    off *= off
                    off *= weight[i]
                    np.add(squares, off, out=squares, where=seen)
                    np.add(total, weight[i], out=total, where=seen)
                    both += seen
                fit = both >= np.maximum(least, np.ceil(sizes / 2))[:, None]
                if apart:
                    fit &= mine[:, None] != ids[None, :]
                with np.errstate(all="ignore"):
                    d = np.sqrt(squares / total)
                    distance = np.where(np.abs(d) < 1e9, np.floor(d * 1e6 + 0.5) / 1e6, d)
                score = np.where(fit, np.where(np.isnan(distance), np.finfo(np.float64).max, distance), np.inf)
                top = min(k, len(ids))
                last = np.partition(score, top - 1, axis=1)[:, top - 1, None]
                below, tie = score < last, score == last
                keep = (below | (tie & (np.cumsum(tie, axis=1) <= top - below.sum(axis=1, keepdims=True)))) & fit
                a, b = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(mine[a]), pa.array(ids[b]), pa.array(prefers[b]), pa.array(d[a, b]), pa.array(distance[a, b])], names=["query_id", "id", "prefer", "d", "distance"])

    dealt = rows.repartition(F.col("by"), F.pmod(F.xxhash64("id"), F.lit(SALT)))
    blocks = _masked_blocks(dealt, MASKED_ROWS).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALT)))
    ask = _masked_blocks(asked.withColumn("prefer", F.lit(0)).repartition("by"), ASKED)
    ask = ask.select(F.col("by").alias("asked_by"), *[F.col(c).alias(f"asked_{c}") for c in ("ids", "data", "known", "sizes")], F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("asked_salt"))
    pairs = blocks.join(ask, (F.col("by") == F.col("asked_by")) & (F.col("salt") == F.col("asked_salt")))
    found = pairs.mapInArrow(run, "query_id bigint, id bigint, prefer bigint, d double, distance double")
    return top_k(found, ["query_id"], [F.col("distance"), F.col("prefer"), F.col("id")], k)


def robust_profile(vectors: DataFrame, cohort: str, values: str) -> DataFrame:
    """(cohort, dim, median, scale): the interquartile range, else 1.4826 MAD, else one."""
    long = vectors.select(cohort, F.posexplode(values).alias("dim", "x")).where("x is not null")
    mid = long.groupBy(cohort, "dim").agg(F.percentile("x", F.lit(0.5)).alias("median"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"), F.count("*").alias("n"))
    mad = long.join(mid, [cohort, "dim"]).groupBy(cohort, "dim").agg((1.4826 * F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5))).alias("mad"))
    both = mid.join(mad, [cohort, "dim"])
    return both.select(cohort, "dim", "n", "median", "iqr", "mad", F.when(F.col("iqr") > EPSILON, F.col("iqr")).when(F.col("mad") > EPSILON, F.col("mad")).otherwise(1.0).alias("scale"))


def normalised(vectors: DataFrame, profile: DataFrame, cohort: str, values: str) -> DataFrame:
    """Vectors in robust units, clipped; missing values stay null. The profile is small: cohorts x dims."""
    wide = profile.groupBy(cohort).agg(F.array_sort(F.collect_list(F.struct("dim", "median", "scale"))).alias("p"))
    out = vectors.join(F.broadcast(wide), cohort)
    return out.withColumn(values, F.expr(f"transform({values}, (x, i) -> if(x is null, null, greatest(-{CLIP}D, least({CLIP}D, (x - p[i].median) / p[i].scale))))")).drop("p")


def masked_distance(a: str, b: str, least: int = 8, weights: str | None = None) -> Column:
    """Weighted root mean square over dimensions both have; null with too few (least, and half of all).

    ``weights`` is an array of a weight for each dimension; without it all weigh the same.
    """
    each = weights or f"transform({a}, x -> 1D)"
    squares = f"filter(zip_with(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), {each}, (d, w) -> if(d is null, null, struct(d * w as d, w as w))), p -> p is not null)"
    total = lambda part: f"aggregate(s, 0D, (t, p) -> t + p.{part})"
    return F.expr(f"transform(array({squares}), s -> if(size(s) >= greatest({least}, ceil(size({a}) / 2)), sqrt({total('d')} / {total('w')}), null))[0]")
