"""Hash trees over the files of a generation: what differs is found by descending where hashes differ.

A leaf is a file (relative path, size, time of change, hash of its bytes), a node the hash of its
children's names and hashes; the children of a node share a prefix of the hash of their path, so trees
of different generations have the same shape. Trees are tables; a comparison reads the nodes below
differing ones only, and a verification hashes again only files whose size or time changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a path's hash that name the lowest inner nodes: with two a node for each 256th file.
DEPTH = 2
NODE = "level int, node string, hash string, n bigint"
LEAF = "path string, size bigint, changed timestamp, sha string"


def listed(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, size, changed) of the data files below a folder, with ``sha`` if contents are to be read."""
    return _relative(spark, folder, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), content)


def _relative(spark: SparkSession, folder: str, found: DataFrame, content: bool) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rel = F.substr(bare, F.lit(len("/" + base.split(":", 1)[-1].lstrip("/")) + 2))
    columns = [rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")]
    return found.select(*columns, F.sha2("content", 256).alias("sha")) if content else found.select(*columns)


def tree(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, hash, n): inner nodes from the root (level 0, node '') to those above the leaves."""
    name = F.sha2(F.col("path").cast("binary"), 256)
    rows = leaves.select(F.substring(name, 1, depth).alias("node"), F.col("path").alias("child"), F.col("sha").alias("hash"), F.lit(1).cast("bigint").alias("n"))
    out = None
    for level in range(depth, -1, -1):
        # children of the lowest nodes are files / 16 ** depth, of others 16
        text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("child", "hash"))), lambda x: F.concat_ws(" ", x["child"], x["hash"])))
        nodes = rows.groupBy("node").agg(F.sha2(text.cast("binary"), 256).alias("hash"), F.sum("n").alias("n")).select(F.lit(level).alias("level"), "node", "hash", "n")
        out = nodes if out is None else out.unionByName(nodes)
        rows = nodes.select(F.substring("node", 1, max(level - 1, 0)).alias("node") if level > 1 else F.lit("").alias("node"), F.col("node").alias("child"), "hash", "n")
    return out


def write(spark: SparkSession, folder: str, to: str, depth: int = DEPTH) -> None:
    """The leaves and the tree of a folder, as tables beside it."""
    listed(spark, folder, content=True).write.mode("errorifexists").parquet(f"{to}/leaves")
    leaves = spark.read.schema(LEAF).parquet(f"{to}/leaves")
    tree(leaves, depth).write.mode("errorifexists").partitionBy("level").parquet(f"{to}/tree")


def _leaves(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(LEAF).parquet(f"{at}/leaves")


def root_of(spark: SparkSession, at: str) -> str | None:
    found = spark.read.schema(NODE).parquet(f"{at}/tree").where("level = 0").first()
    return found.hash if found else None


def _named(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("path", F.col("sha").alias("x")).join(b.select("path", F.col("sha").alias("y")), "path", "full_outer").where("not x <=> y")
    return both.select("path", F.when(F.col("x").isNull(), "ADDED").when(F.col("y").isNull(), "LOST").otherwise("CHANGED").alias("change"))


def differences(spark: SparkSession, a: str, b: str, depth: int = DEPTH) -> tuple[DataFrame, int]:
    """(path, change) from tree ``a`` to ``b``, and how many nodes were compared.

    From the root down, only children of differing nodes are looked at.
    """
    trees = [spark.read.schema(NODE).parquet(f"{x}/tree") for x in (a, b)]
    open_nodes, seen = [""], 0
    for level in range(depth + 1):
        below = F.col("level") == level
        if level:
            below &= F.substring("node", 1, level - 1).isin(open_nodes) if level > 1 else F.lit(True)
        mine, theirs = (t.where(below).select("node", F.col("hash").alias(h)) for t, h in zip(trees, "xy", strict=True))
        rows = mine.join(theirs, "node", "full_outer").collect()  # sixteen for each differing node above
        seen += len(rows)
        open_nodes = [r.node for r in rows if r.x != r.y]
        if not open_nodes:
            break
    leaf = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, depth).isin(open_nodes)
    return _named(_leaves(spark, a).where(leaf), _leaves(spark, b).where(leaf)), seen


def verified(spark: SparkSession, folder: str, at: str) -> tuple[DataFrame, int]:
    """(path, change) of files that aren't what the tree says, and how many files were read again.

    Files of the size and time that the leaves have are taken for unchanged.
    """
    leaves, now = _leaves(spark, at), listed(spark, folder)
    suspect = now.join(leaves, ["path", "size", "changed"], "left_anti").select("path")
    paths = [f"{folder}/{r.path}" for r in suspect.collect()]  # few, or the generation is to be built anew
    again = _relative(spark, folder, spark.read.format("binaryFile").load(paths), content=True).select("path", "sha") if paths else None
    same = now.join(suspect, "path", "left_anti").join(leaves.select("path", "sha"), "path").select("path", "sha")
    return _named(leaves, same.unionByName(again) if again is not None else same), len(paths)
