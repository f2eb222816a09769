"""Document fingerprints by winnowing, with SQL functions only.

Tokens are words of up to 16 code points between white space; of a longer run (text without blanks,
addresses, encoded data) each code point is a token, so what is inserted before a place never shifts
the tokens after it. The hashes of every k consecutive tokens roll over the text; of every w
consecutive hashes the least is chosen, the rightmost of equals, and kept with its position. Two
texts that share k + w - 1 consecutive tokens thus share a chosen hash, with both positions known.

A chosen gram is one long: 39 bits of the complemented hash above 24 bits of the position (modulo
2**24), so ``array_max`` over a window finds the rightmost least hash.

Edge cases: null texts count as empty; a text without tokens has an empty fingerprint; one of fewer
than k tokens has one gram of all. Two empty fingerprints are alike (1), an empty and another are
not (0). Rows are ordered by doc_id, nulls first, then by text; repeated rows stay neighbours; the
row after the last is the first, which for a single row is itself. A very long text is one row of
arrays. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut, prepare, table

K, W = 5, 8
#: A word of up to 16 code points, else each code point of a run.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: Bytes of text in a range of doc_ids.
BUCKET_BYTES = 16 << 20


def winnowed(text: str, k: int = K, w: int = W) -> Column:
    """The chosen grams of a text column, in order of position; arrays are bound once by ``transform``."""
    gram = ", ".join(f"h[i + {j}]" for j in range(k))
    pack = lambda value, at: f"shiftleft(549755813887 - shiftrightunsigned({value}, 25), 24) | ({at} & 16777215)"
    pattern = TOKEN.replace("\\", "\\\\")
    tokens = f"regexp_extract_all(coalesce({text}, ''), '{pattern}', 0)"
    grams = f"if(size(h) >= {k}, transform(sequence(0L, size(h) - {k}L), i -> {pack(f'xxhash64({gram})', 'i')}), if(size(h) = 0, cast(array() as array<bigint>), array({pack('xxhash64(h)', '0L')})))"
    chosen = f"if(size(g) <= {w}, if(size(g) = 0, g, array(array_max(g))), array_distinct(transform(sequence(1, size(g) - {w - 1}), i -> array_max(slice(g, i, {w})))))"
    return F.expr(f"transform(transform(transform(array({tokens}), t -> transform(t, x -> xxhash64(x))), h -> {grams}), g -> {chosen})[0]")


def hashes(chosen: str) -> Column:
    """The distinct hashes of chosen grams."""
    return F.expr(f"array_distinct(transform({chosen}, e -> shiftright(e, 24)))")


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two columns of distinct hashes."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double))")


def written(chosen: str) -> Column:
    """A fingerprint as text: each hash in base 16 and its position."""
    return F.expr(f"array_join(transform({chosen}, e -> concat(lower(hex(549755813887 - shiftright(e, 24))), '@', e & 16777215)), ',')")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id and fingerprint of every row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", winnowed("text", k, w).alias("g")).select("doc_id", written("g").alias("fingerprint"))


def with_next(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """doc_id, text, the given columns, and the same of the next row as a struct ``next``.

    Rows are dealt once, by ranges of doc_id; the first row of each range is also sent to the range
    before it, so no order over the whole table is needed. Ranges are found in two steps, each of
    the square root of their number: the first step's borders are part of the plan, the second
    step's a table with a row for each of the first, so both stay small whatever the corpus.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    step = max(2, math.isqrt(n - 1) + 1)
    shares = [i / step for i in range(1, step)]
    borders = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * step)).first()[0] or []))
    part = F.expr(f"size(filter(array({', '.join(f'{v}L' for v in borders)}), c -> c <= doc_id))") if borders else F.lit(0)
    rough = docs.withColumn("part", F.coalesce(part, F.lit(0)))
    fine = rough.groupBy("part").agg(F.array_sort(F.array_distinct(F.percentile_approx("doc_id", shares, 10 * step))).alias("cuts"))
    found = rough.join(F.broadcast(cut(fine)), "part", "left")
    inner = F.coalesce(F.expr("size(filter(cuts, c -> c <= doc_id))"), F.lit(0))
    dealt = found.select("doc_id", "text", (F.col("part").cast("bigint") * step + inner).alias("bucket"), F.lit(0).alias("tail"))
    least = dealt.groupBy("bucket").agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("least"))
    least = least.select("bucket", F.when(F.col("nulls") == 0, F.col("least")).alias("least"))
    order = Window.orderBy("bucket")  # over the buckets: a short row for each BUCKET_BYTES
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = least.select("bucket", "least", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every)).alias("before"))
    at = F.broadcast(before.withColumnRenamed("bucket", "of"))
    heads = dealt.join(at, (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("before").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    rows = dealt.select("bucket", "tail", "doc_id", "text").union(heads.select("before", F.lit(1), "doc_id", "text"))
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), "bucket").select("bucket", "tail", "doc_id", "text", *columns)
    names = [c for c in rows.columns if c not in ("bucket", "tail", "doc_id")]
    after = F.lead(F.struct(*names)).over(Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text"))
    return rows.withColumn("next", after).where("tail = 0").drop("bucket", "tail")


def edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of the text whose second half is the next one's beginning."""
    both = with_next(docs, [F.length("text").cast("bigint").alias("n_chars"), winnowed("text", k, w).alias("g")])
    half = "cast(n_chars div 2 as int)"
    both = both.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {half}), left(next.text, {half}))"))
    both = both.withColumn("eg", winnowed("edited", k, w))
    sets = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "g", "eg", hashes("g").alias("a"), hashes("eg").alias("b"), hashes("next.g").alias("c"))
    return sets.select("doc_id", "n_chars", "edited_sha256", written("g").alias("fingerprint"), written("eg").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
