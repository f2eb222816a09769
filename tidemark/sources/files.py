"""File sources and sinks: tolerant CSV, tick files, decision logs, macro vintages, generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = "Date string, Open string, High string, Low string, Close string, Volume string"
TICK = "symbol string, timestamp string, bid double, ask double, point double"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, if it has the columns; else an error that names those missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ohlcv(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """Daily bars from CSV: malformed lines and rows without a date go, bad numbers become null.

    Dates keep the wall clock they are written with. Rows after ``as_of`` are dropped first.
    """
    rows = spark.read.csv(path, header=True, schema=OHLCV, mode="DROPMALFORMED")
    number = lambda c: F.expr(f"nanvl(try_cast({c} as double), null)").alias(c.lower())
    rows = rows.select(F.expr("try_to_date(substr(Date, 1, 10))").alias("date"), *[number(c) for c in ("Open", "High", "Low", "Close", "Volume")]).where("date is not null")
    return rows.where(F.col("date") <= F.lit(as_of).cast("date")) if as_of else rows


def ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks by suffix: JSON lines, a JSON list or object with ``ticks``, or CSV with a header."""
    if path.endswith(".jsonl"):
        return spark.read.schema(TICK).json(path)
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        either = F.coalesce(F.from_json("value", f"struct<ticks:array<struct<{_fields()}>>>")["ticks"], F.from_json("value", f"array<struct<{_fields()}>>"))
        return text.select(F.explode(either).alias("t")).select("t.*")
    return spark.read.csv(path, header=True, schema=TICK, mode="DROPMALFORMED")


def _fields() -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in TICK.split(","))


def decision_log(spark: SparkSession, path: str, separator: str = "\n---\n") -> DataFrame:
    """(entry, date, ticker, rating, pending, body) of a Markdown log of separated blocks.

    The first line of a block is ``[date | ticker | rating | outcome]``; pending ones await an outcome.
    """
    blocks = spark.read.text(path, lineSep=separator).select(F.monotonically_increasing_id().alias("entry"), F.trim("value").alias("value")).where("value <> ''")
    head = F.regexp_extract("value", r"^\[([^\]]*)\]", 1)
    parts = F.split(head, r"\s*\|\s*")
    return blocks.select("entry", F.get(parts, F.lit(0)).alias("date"), F.get(parts, F.lit(1)).alias("ticker"), F.get(parts, F.lit(2)).alias("rating"), F.coalesce(F.get(parts, F.lit(3)) == "pending", F.lit(True)).alias("pending"), F.trim(F.regexp_replace("value", r"^\[[^\]]*\]\s*", "")).alias("body"))


def vintage(series: DataFrame, as_of: str) -> DataFrame:
    """(date, value) as known on a date: of a bitemporal series the version then current; "." is missing."""
    seen = series.where((F.col("realtime_start") <= as_of) & (F.col("realtime_end") >= as_of))
    return seen.select("date", F.expr("try_cast(nullif(value, '.') as double)").alias("value"))


def articles(rows: DataFrame) -> DataFrame:
    """Titles and publishers of articles that nest them under ``content`` or don't."""
    return rows.select(F.coalesce("content.title", "title").alias("title"), F.coalesce("content.provider", "publisher").alias("publisher"), F.coalesce("content.pubDate", "date").alias("published"))


def write_generation(rows: DataFrame, path: str, split: str = "split") -> None:
    """A generation of JSON lines by split; one that exists is never overwritten."""
    rows.write.mode("errorifexists").partitionBy(split).json(path)


def manifest(rows: DataFrame, split: str = "split") -> DataFrame:
    """Counts and an order-independent hash of each split, to be compared with a generation read back."""
    columns = sorted(c for c in rows.columns if c != split)
    h = F.xxhash64(F.to_json(F.struct(*columns)))
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.sum((h % (1 << 40)).cast("decimal(38,0)")).alias("hash"))


def verified(rows: DataFrame, again: DataFrame, split: str = "split") -> DataFrame:
    """A generation read back, if each split has the rows that were written; else an error that names the splits."""
    a, b = manifest(rows, split), manifest(again, split)
    both = a.join(b.select(F.col(split).alias("s"), F.col("n").alias("m"), F.col("hash").alias("h")), a[split].eqNullSafe(F.col("s")), "full_outer").where("not (n <=> m and hash <=> h)")
    if wrong := [str(r[0]) for r in both.select(F.coalesce(split, "s")).limit(5).collect()]:
        raise RuntimeError(f"rows differ from those written: {', '.join(sorted(wrong))}")
    return again


def publish(rows: DataFrame, root: str, generation: str) -> None:
    """A new generation beside the others, then the pointer that makes it the active one.

    The pointer is a small file put in place by one rename, so a reader finds the generation before
    or this one, never none (where the file system renames at once, as HDFS and local ones do).
    """
    rows.write.mode("errorifexists").parquet(f"{root}/{generation}")
    spark = rows.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    fresh, pointer = fs.Path(f"{root}/active-{uuid.uuid4().hex}"), fs.Path(f"{root}/active")
    out = fresh.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh)
    out.write(bytearray(generation.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(fresh.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, how)


def active(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the active generation."""
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/active', wholetext=True).first().value}")
