"""A partitioned vector index: a coarse quantiser, probes of the nearest cells, and an exact way by bounds.

Directions are parted into cells by centroids that are fitted on a bounded sample (``FIT`` rows at most,
chosen by a hash of the id); every row is then assigned to its nearest centroid and written sorted by
cell. A search compares a query with all rows of the cells nearest to it by exact cosines, so only
neighbours in other cells can be missed; how many cells are probed comes from measuring, for a bounded
sample of queries, where the true neighbours are. The exact way goes on from there: a cell's widest
angle bounds how like its best row can be, and cells that could still hold a better one are read too.

Rows of a cell are dealt over ``SALT`` groups, so one that holds a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.similarity import GROUP, met, nearest, top_k
from tidemark.session import cut

#: Rows that fit the centroids, most centroids, queries that choose the probes (bounds of what comes to the driver).
FIT, CELLS, ASKED = 20_000, 1024, 400
ROUNDS, SALT = 12, 16
#: Rows of a cell that are compared as one part (about), up to ``SALT`` parts.
PART = 8192
#: Rounded cosines may pass a bound by this.
SLACK = 2e-6
ROWS = "id bigint, cell int, salt int, v array<double>"


class Vectors(NamedTuple):
    """An index: the folder of its rows, the centroids, and each cell's widest angle (-1 for none) and rows."""

    path: str
    centroids: np.ndarray
    angles: np.ndarray
    sizes: np.ndarray
    probes: int


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _clean(rows: DataFrame, dims: int) -> DataFrame:
    v = F.col("v").cast("array<double>")
    good = F.col("id").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    return rows.where(good).select(F.col("id").cast("bigint").alias("id"), v.alias("v"))


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Units of at most ``most`` rows, those of the least hashes of their ids."""
    picked = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(most).toArrow()
    return _unit(_matrix(picked.column("v"))) if picked.num_rows else np.zeros((0, 0))


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a cell without rows keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        cell = (sample @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, sample)
        full = np.linalg.norm(total, axis=1) > 0
        centroids[full] = _unit(total[full])
    return centroids


def build(rows: DataFrame, path: str, dims: int, k: int = 10, least: float = 0.97, cells: int | None = None) -> Vectors:
    """Index all rows (id, v) of finite numbers in ``dims`` dimensions below a folder.

    ``probes`` is chosen so that ``least`` of the true neighbours of sampled rows are in probed cells.
    """
    spark = rows.sparkSession
    rows = _clean(rows, dims)
    sample = _sampled(rows, FIT)
    cells = cells or max(1, min(CELLS, int(len(sample) ** 0.5)))
    centroids = fitted(sample, min(cells, len(sample)), ROUNDS) if len(sample) else np.zeros((1, dims))
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _unit(_matrix(batch.column("v")))
                cell = (units @ sent.value.T).argmax(axis=1).astype(np.int32)
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, units.shape[1], dtype=np.int32)), pa.array(units.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell), v], names=["id", "cell", "v"])

    assigned = rows.mapInArrow(assign, "id bigint, cell int, v array<double>").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    assigned.select("id", "cell", "salt", "v").repartition("cell", "salt").sortWithinPartitions("cell", "salt").write.mode("errorifexists").parquet(path)
    written = spark.read.schema(ROWS).parquet(path)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, n = np.full(len(sent.value), -1.0), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                near = np.clip((_matrix(batch.column("v")) * sent.value[cell]).sum(axis=1), -1, 1)
                np.maximum.at(far, cell, np.arccos(near))
                n += np.bincount(cell, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(far)), pa.int32()), pa.array(far), pa.array(n)], names=["cell", "angle", "n"])

    angles, sizes = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for r in written.mapInArrow(widest, "cell int, angle double, n bigint").groupBy("cell").agg(F.max("angle").alias("angle"), F.sum("n").alias("n")).collect():
        angles[r.cell], sizes[r.cell] = r.angle, r.n
    index = Vectors(path, centroids, angles, sizes, 1)
    return index._replace(probes=probes_for(index, spark, k, least))


def probes_for(index: Vectors, spark: SparkSession, k: int, least: float) -> int:
    """The fewest probes with which ``least`` of the neighbours of at most ``ASKED`` rows are found."""
    rows = spark.read.schema(ROWS).parquet(index.path)
    asked = cut(rows.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(ASKED).select("id", "v"))
    true = nearest(rows.select("id", "v"), asked, k).join(rows.select(F.col("id").alias("doc_id"), "cell"), "doc_id").select("query_id", "cell").collect()
    if not true:
        return 1
    table = asked.toArrow()
    place = {i: q for q, i in enumerate(table.column("id").to_pylist())}
    order = np.argsort(-(_matrix(table.column("v")) @ index.centroids.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    at = np.sort(np.array([rank[place[r.query_id], r.cell] for r in true]))
    return int(at[min(len(at) - 1, int(np.ceil(least * len(at))) - 1)]) + 1


def _probed(asked: DataFrame, index: Vectors, probes: int) -> DataFrame:
    """(query_id, cell, v, place, bound) for the cells nearest to each query; ``bound`` is how like a row there can be."""
    sent = asked.sparkSession.sparkContext.broadcast((index.centroids, index.angles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, angles = sent.value
        for batch in batches:
            if batch.num_rows:
                units = _unit(_matrix(batch.column("v")))
                like = units @ centroids.T
                order = np.argsort(-like, axis=1, kind="stable")[:, :probes]
                n, p = order.shape
                apart = np.arccos(np.clip(np.take_along_axis(like, order, axis=1), -1, 1)) - angles[order]
                bound = np.where(angles[order] < 0, -2.0, np.cos(np.clip(apart, 0, np.pi)))
                bound[np.linalg.norm(units, axis=1) == 0] = np.where(angles[order[np.linalg.norm(units, axis=1) == 0]] < 0, -2.0, 1.0)
                row = np.repeat(np.arange(n), p)
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p * units.shape[1] + 1, units.shape[1], dtype=np.int32)), pa.array(units[row].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(order.ravel().astype(np.int32)), v, pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(bound.ravel())], names=["query_id", "cell", "v", "place", "bound"])

    return asked.mapInArrow(run, "query_id bigint, cell int, v array<double>, place int, bound double").where("bound > -2")


def _compared(index: Vectors, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k rows of each part of a cell for the queries that probe it.

    A cell has a part for each ``PART`` of its rows, and a query goes to the parts of cells it probes.
    """
    spark = probes.sparkSession
    salts = F.element_at(F.lit(np.maximum(1, np.minimum(SALT, -(-index.sizes // PART))).tolist()), F.col("cell") + 1)
    groups = -(-max(probes.select("query_id").distinct().count(), 1) // GROUP)
    rows = spark.read.schema(ROWS).parquet(index.path).select("cell", (F.col("salt") % salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id", "v")
    asked = probes.select("cell", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "v")
    return met(rows.unionByName(asked), ["cell", "salt", "group"], k, max(SALT, len(index.centroids) // 2) * groups, unit=True)


def search(index: Vectors, asked: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows most like each asked one (id, v), itself left out.

    As ``similarity.nearest``, of the rows in the probed cells; with ``exact`` of all rows.
    """
    asked = _clean(asked, index.centroids.shape[1])
    probes = probes or index.probes
    order = [F.desc("score"), F.col("doc_id")]
    if not exact:
        return top_k(_compared(index, _probed(asked, index, probes), k), ["query_id"], order, k)
    every = cut(_probed(asked, index, len(index.centroids)))
    found = cut(top_k(_compared(index, every.where(F.col("place") < probes), k), ["query_id"], order, k).select("query_id", "doc_id", "score"))
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    more = every.where(F.col("place") >= probes).join(least, "query_id", "left").where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("bound") + SLACK >= F.col("least")))
    return top_k(found.unionByName(_compared(index, more, k)), ["query_id"], order, k)
