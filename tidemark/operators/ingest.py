"""Incremental ingest: what a folder or feed holds now, merged by content into generations of documents.

A *resource* is a path, a *document* a content, named by its hash; several resources may be aliases of
one document. A run compares the resources found with those of the active generation, parses only
contents that no document has, and writes a new generation that shares every part of the document
table without a new or an orphaned document with older ones. The pointer moves last, by one rename:
a run that dies before leaves folders that nobody reads, and the next one begins anew. A run that
finds nothing changed writes nothing.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources import files

RESOURCES, DOCUMENTS, MANIFEST = "path string, sha string, state string", "sha string, text string", "part int, generation string, resources string"
#: Parts of the document table, by the hash of the content.
PARTS = 64
GONE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Catalog(NamedTuple):
    """The active generation: its name, aliases, documents, and where each part lies."""

    generation: str | None
    resources: DataFrame
    documents: DataFrame
    places: dict[int, str]


def opened(spark: SparkSession, root: str) -> Catalog:
    """The active generation; an empty one where nothing was ingested yet."""
    try:
        rows = files.active(spark, f"{root}/manifests").collect()  # a row for each part
    except AnalysisException as e:
        if e.getCondition() not in GONE:
            raise
        return Catalog(None, spark.createDataFrame([], RESOURCES), spark.createDataFrame([], DOCUMENTS), {})
    places = {r.part: r.generation for r in rows if r.generation}
    paths = [f"{root}/{g}/documents/part={p}" for p, g in sorted(places.items())]
    documents = spark.read.schema(DOCUMENTS).parquet(*paths) if paths else spark.createDataFrame([], DOCUMENTS)
    return Catalog(rows[0].resources, spark.read.schema(RESOURCES).parquet(f"{root}/{rows[0].resources}/resources"), documents, places)


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha, text) of the files below a folder; text is null where it isn't UTF-8. Files are read by executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select("path", F.sha2("content", 256).alias("sha"), text.alias("text"))


def _part(parts: int) -> object:
    return F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int")


def ingest(found: DataFrame, root: str, parts: int = PARTS) -> DataFrame:
    """(path, state) of what a run does with the resources found (path, sha, text), one row a path.

    INDEXED: the first path of a content that is new; DUPLICATE: another path of a content; UNCHANGED;
    FAILED: a content that couldn't be read (text is null), which keeps no alias; REMOVED: no longer
    found. Documents without an alias go.
    """
    spark = found.sparkSession
    before = opened(spark, root)
    now = cut(found.select("path", "sha"))
    known = before.documents.select("sha")
    fresh = now.join(known, "sha", "left_anti").groupBy("sha").agg(F.min("path").alias("path"))
    parsed = cut(found.join(fresh.select("path"), "path", "left_semi").select("path", "sha", "text"))
    bad = parsed.where("text is null").select("sha").withColumn("bad", F.lit(True))
    mine = before.resources.select("path", F.col("sha").alias("old"), F.col("state").alias("was"))
    both = now.join(mine, "path", "full_outer").join(bad, "sha", "left").join(parsed.where("text is not null").select("path", F.lit(True).alias("first")), "path", "left")
    state = F.when(F.col("sha").isNull(), "REMOVED").when(F.col("bad"), "FAILED").when(F.col("sha") == F.col("old"), "UNCHANGED").when(F.col("first"), "INDEXED").otherwise("DUPLICATE")
    judged = cut(both.select("path", "sha", "old", "was", state.alias("state")).where("not (state = 'REMOVED' and was = 'FAILED')"))
    quiet = judged.where("state not in ('UNCHANGED', 'FAILED') or (state = 'FAILED' and not old <=> sha)").isEmpty()
    if not (quiet and before.generation):
        _publish(spark, root, before, judged, parsed, parts)
    return judged.select("path", "state")


def _publish(spark: SparkSession, root: str, before: Catalog, judged: DataFrame, parsed: DataFrame, parts: int) -> None:
    generation = f"g-{uuid.uuid4().hex}"
    kept = judged.where("state <> 'REMOVED'").select("path", "sha", "state")
    alive = kept.where("state <> 'FAILED'").select("sha").distinct()
    new = parsed.where("text is not null").select("sha", "text").dropDuplicates(["sha"])
    orphans = before.documents.select("sha").join(alive, "sha", "left_anti")
    touched = {r.part for r in new.select("sha").unionByName(orphans).select(_part(parts).alias("part")).distinct().collect()}
    old = [f"{root}/{g}/documents/part={p}" for p, g in before.places.items() if p in touched]
    rows = new.unionByName(spark.read.schema(DOCUMENTS).parquet(*old).join(alive, "sha", "left_semi")) if old else new
    dealt = rows.withColumn("part", _part(parts))
    dealt.repartition("part").write.mode("errorifexists").partitionBy("part").parquet(f"{root}/{generation}/documents")
    kept.write.mode("errorifexists").parquet(f"{root}/{generation}/resources")
    written = set()
    if touched and not rows.isEmpty():
        written = {r.part for r in spark.read.schema("part int").parquet(f"{root}/{generation}/documents").select("part").distinct().collect()}
    places = {p: g for p, g in before.places.items() if p not in touched} | dict.fromkeys(written, generation)
    manifest = [(p, g, generation) for p, g in sorted(places.items())] or [(-1, None, generation)]
    files.publish(spark.createDataFrame(manifest, MANIFEST), f"{root}/manifests", generation)
