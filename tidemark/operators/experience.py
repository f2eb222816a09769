"""Past experiences like a question, what became of them, and whether that is evidence enough, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import similarity


def similar(accepted: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, least: int = 8) -> DataFrame:
    """(query_id, experience_id, distance, rank) of the k experiences nearest to each question.

    ``accepted`` are (experience_id, at_us, vec_id), those that a gate lets pass; ``vectors`` (vec_id,
    v); ``asked`` (query_id, v). Of equal distances the later experience comes first. All are
    compared, but experiences of one vector are equally far: of each vector the first k count, and the
    k vectors that are nearest, told by their first experience, hold the k nearest experiences.
    """
    order = [F.desc_nulls_last("at_us"), F.col("experience_id")]
    few = similarity.top_k(accepted.select("experience_id", "at_us", "vec_id"), ["vec_id"], order, k).withColumnRenamed("rank", "place")
    places = few.where("place = 1").select("vec_id", (-F.col("at_us")).alias("prefer"), F.col("experience_id").alias("id"))
    rows = places.join(vectors, "vec_id").select(F.lit(0).alias("by"), "id", F.coalesce("prefer", F.lit((1 << 63) - 1)).alias("prefer"), "v")
    near = similarity.masked_nearest(rows, asked.select(F.lit(0).alias("by"), F.col("query_id").alias("id"), "v"), k, least)
    near = near.join(places.select("id", "vec_id"), "id").select("query_id", "vec_id", "distance")
    return similarity.top_k(near.join(few, "vec_id"), ["query_id"], [F.col("distance"), *order], k).select("query_id", "experience_id", "distance", "rank")


def outcomes(snapshots: DataFrame, basis: str, horizon_s: int, as_of_us: int) -> DataFrame:
    """(experience_id, net): the result known last by an instant, of complete evaluations of one basis and horizon."""
    known = snapshots.where((F.col("basis") == basis) & (F.col("horizon_s") == horizon_s) & (F.col("available_us") <= as_of_us) & (F.col("status") == "COMPLETE") & F.col("net").isNotNull())
    return known.groupBy("experience_id").agg(F.max_by("net", F.struct("available_us", "fingerprint")).alias("net"))


def evidence(asked: DataFrame, found: DataFrame, results: DataFrame, least: int = 3) -> DataFrame:
    """A row for each question: how many experiences are like it, what became of them, and a status.

    UNAVAILABLE without any, PARTIAL with fewer than ``least`` results, else COMPLETE.
    """
    rows = found.join(results, "experience_id", "left")
    counted = rows.groupBy("query_id").agg(F.count("*").alias("alike"), F.count("net").alias("known"), F.avg("net").alias("mean_net"), F.min("distance").alias("nearest"), F.min_by("experience_id", "rank").alias("first"))
    out = asked.select("query_id").join(counted, "query_id", "left")
    n = F.coalesce("alike", F.lit(0))
    status = F.when(n == 0, "UNAVAILABLE").when(F.col("known") < least, "PARTIAL").otherwise("COMPLETE")
    return out.select("query_id", n.alias("alike"), F.coalesce("known", F.lit(0)).alias("known"), "mean_net", "nearest", "first", status.alias("status"))
