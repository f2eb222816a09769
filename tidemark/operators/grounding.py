"""Grounding of claims: references that exist, words that sources share, claims that contradict each other.

Claims meet the blocks they cite by reference, and each other only where their polarity is opposed (one
is negated and the other isn't, or one says more and the other less) and they share a word: a join by
(candidate, axis, word), so claims that agree are never paired. The first failure in the order of a
reader decides a candidate: its sources, then each claim's references, text and support, then pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without content, words about claims, negations, pairs of opposed words, and what a reference must agree in.
STOP = ["a", "an", "and", "by", "for", "from", "in", "is", "of", "on", "the", "to", "with"]
META = ["claim", "evidence", "scope", "source", "supplied", "concept", "defines", "defined"]
NEGATIONS = ["not", "never", "no", "without", "cannot"]
OPPOSITES = [
    (["increase", "increases", "increased", "increasing", "higher", "more"], ["decrease", "decreases", "decreased", "decreasing", "lower", "less"]),
    (["available", "present", "exists"], ["unavailable", "absent", "missing"]),
]
PROVENANCE = ["document_id", "source_filename", "source_hash", "chunk_id", "generation_id", "page", "page_start", "page_end", "chapter", "section", "content_type"]
SHARED, SHARE = 2, 0.7

CLAIMS = "candidate bigint, i int, text string, refs array<struct<ref:string,fields:map<string,string>>>"


def words(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), _of(STOP))


def _of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def cited(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(candidate, ..., failure, text) of references (candidate, ref, fields, ...): why one can't stand, and what it points to.

    One that names no block of the candidate is GROUNDING_FAILED; one with fields that lack or contradict
    a field of the block SOURCE_PROVENANCE_INCOMPLETE. A bare name (fields is null) only has to exist.
    """
    known = blocks.groupBy("candidate", "ref").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.map_entries("fields").alias("e"))).alias("b"))
    known = known.select(F.col("candidate").alias("c_"), F.col("ref").alias("r_"), F.col("b.text").alias("text"), F.map_from_entries("b.e").alias("theirs"))
    rows = refs.join(known, (refs.candidate == known["c_"]) & (refs.ref == known["r_"]), "left")
    wrong = F.lit(False)
    for name in PROVENANCE:
        mine, theirs = F.try_element_at("fields", F.lit(name)), F.try_element_at("theirs", F.lit(name))
        wrong = wrong | F.coalesce(theirs.isNotNull() & ~mine.eqNullSafe(theirs), F.lit(False))
    failure = F.when(F.col("r_").isNull(), "GROUNDING_FAILED").when(F.col("fields").isNotNull() & wrong, "SOURCE_PROVENANCE_INCOMPLETE")
    return rows.withColumn("failure", failure).drop("c_", "r_", "theirs")


def contradictions(claims: DataFrame) -> DataFrame:
    """(candidate, i, j), i < j: claims (candidate, i, text) that contradict each other."""
    all_words = words(F.col("text"))
    rows = claims.where("trim(text) <> ''").select("candidate", "i", F.arrays_overlap(all_words, _of(NEGATIONS)).alias("negated"), F.array_except(all_words, _of(NEGATIONS)).alias("w"))
    sides = [F.struct(F.lit(0).alias("axis"), F.col("negated").cast("int").alias("side"))]
    for axis, pair in enumerate(OPPOSITES, 1):
        sides += [F.when(F.arrays_overlap("w", _of(side)), F.struct(F.lit(axis).alias("axis"), F.lit(k).alias("side"))) for k, side in enumerate(pair)]
    marked = rows.select("candidate", "i", F.size("w").alias("n"), "w", F.explode(F.array_compact(F.array(*sides))).alias("m")).select("candidate", "i", "n", "m.axis", "m.side", F.explode("w").alias("word"))
    a = marked.where("side = 0").select("candidate", "axis", "word", F.col("i").alias("a"), F.col("n").alias("na"))
    b = marked.where("side = 1").select("candidate", "axis", "word", F.col("i").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["candidate", "axis", "word"]).where("a <> b").groupBy("candidate", "axis", "a", "b", "na", "nb").agg(F.count("*").alias("k"))
    real = met.where((F.col("axis") > 0) | (F.col("k") >= SHARED) & (F.col("k") / F.least("na", "nb") >= SHARE))
    return real.select("candidate", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def grounded(candidates: DataFrame, claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(candidate, accepted, reason, i, j): whether a candidate's claims rest on its sources.

    ``candidates`` have refs, as claims (CLAIMS) do; ``blocks`` are (candidate, ref, text, fields). ``i``
    and ``j`` name the claims that fail.
    """
    none = F.lit(None).cast("int")
    listed = candidates.select("candidate", F.posexplode("refs").alias("at", "r")).select("candidate", "at", "r.*")
    own = cited(listed, blocks).where("failure is not null").groupBy("candidate").agg(F.min_by("failure", "at").alias("failure")).select("candidate", F.struct(F.lit(1).alias("step"), none.alias("i"), none.alias("j"), F.col("failure").alias("reason")).alias("f"))
    any_claim = claims.groupBy("candidate").agg(F.count("*").alias("n"))
    bare = candidates.join(any_claim, "candidate", "left").where("n is null or coalesce(size(refs), 0) <= 0").select("candidate", F.struct(F.lit(0).alias("step"), none.alias("i"), none.alias("j"), F.lit("GROUNDING_FAILED").alias("reason")).alias("f"))
    # an outer explode, as a claim without references fails by that
    each = claims.select("candidate", "i", words(F.col("text")).alias("w"), F.coalesce(F.trim("text"), F.lit("")).alias("said"), F.posexplode_outer("refs").alias("at", "r"))
    each = each.select("candidate", "i", "w", "said", "at", F.col("r.ref").alias("ref"), F.col("r.fields").alias("fields"))
    shared = F.size(F.array_intersect("w", words(F.col("text")))) >= SHARED
    judged = cited(each, blocks).withColumn("supported", F.coalesce(shared, F.lit(False))).groupBy("candidate", "i").agg(
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.coalesce("at", F.lit(-1)))).alias("failure"), F.first("said").alias("said"), F.first("w").alias("w"), F.bool_or("supported").alias("supported")
    )
    texts = blocks.groupBy("candidate").agg(F.bool_or(F.coalesce("text", F.lit("")) != "").alias("texts"))
    why = F.coalesce("failure", F.when(F.coalesce("texts", F.lit(False)) & ((F.col("said") == "") | ~F.col("supported") & ~F.arrays_overlap("w", _of(META))), "UNSUPPORTED_CLAIM"))
    failed = judged.join(texts, "candidate", "left").withColumn("why", why).where("why is not null").select("candidate", F.struct(F.lit(2).alias("step"), F.col("i").alias("i"), none.alias("j"), F.col("why").alias("reason")).alias("f"))
    against = contradictions(claims).select("candidate", F.struct(F.lit(3).alias("step"), "i", "j", F.lit("CONTRADICTION").alias("reason")).alias("f"))
    first = bare.unionByName(own).unionByName(failed).unionByName(against).groupBy("candidate").agg(F.min("f").alias("f"))
    return candidates.select("candidate").join(first, "candidate", "left").select("candidate", F.col("f").isNull().alias("accepted"), "f.reason", "f.i", "f.j")
