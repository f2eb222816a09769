"""Intake: vendor ranges and vintages, broker history, inventories of files, merges and quarantine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import epoch_us

#: A vendor's column names by indicator.
INDICATOR_COLUMNS = {
    "macd": "MACD", "macds": "MACD_Signal", "macdh": "MACD_Hist", "boll": "Real Middle Band", "boll_ub": "Real Upper Band", "boll_lb": "Real Lower Band",
    "rsi": "RSI", "atr": "ATR", "close_10_ema": "EMA", "close_50_sma": "SMA", "close_200_sma": "SMA",
}
#: Words that no key and no text of a projection may have.
SENSITIVE = r"(?i)(prompt|completion|reasoning|chain[ _-]?of[ _-]?thought|\bcot\b|private[ _-]?reasoning|secret|password|credential|api[ _-]?key|token)"


def bars_between(bars: DataFrame, start: str, end: str, digits: int = 2) -> DataFrame:
    """Daily bars of both days inclusive, prices rounded; ``date`` is a date."""
    prices = [F.round(c, digits).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in bars.columns]
    return bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(*prices)


def indicator(spark: SparkSession, path: str, name: str, start: str, end: str) -> DataFrame:
    """(date, value) of a vendor's indicator file, ascending: its time and value columns found by name.

    An indicator without a known name takes the second column. Lines without a date are skipped.
    """
    rows = spark.read.csv(path, header=True)
    names = {c.strip(): c for c in rows.columns}
    if "time" not in names:
        raise ValueError(f"no column time among {', '.join(names)}")
    wanted = INDICATOR_COLUMNS.get(name)
    if wanted and wanted not in names:
        raise ValueError(f"no column {wanted} for {name} among {', '.join(names)}")
    value = names[wanted] if wanted else rows.columns[1]
    quoted = lambda c: F.col(f"`{c}`")
    out = rows.select(F.expr(f"try_to_date(trim(`{names['time']}`), 'yyyy-MM-dd')").alias("date"), F.trim(quoted(value)).alias("value"))
    return out.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date")


def reports_asof(rows: DataFrame, reports: str, as_of: str) -> DataFrame:
    """Rows whose array of reports holds only those with ``fiscal_end`` up to a day (compared as text)."""
    return rows.withColumn(reports, F.filter(reports, lambda r: r["fiscal_end"] <= as_of))


def columns_asof(wide: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """(keys, period, value): the columns of a statement headed by a day up to ``as_of``, as rows.

    Headers that are no day are left out, like later ones.
    """
    days = [c for c in wide.columns if c not in keys and re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", c) and c[:10] <= as_of[:10]]
    if not days:
        return wide.select(*keys, F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("value")).limit(0)
    return wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in days]).unpivot(keys, days, "period", "value").withColumn("period", F.substring("period", 1, 10))


def history(rows: DataFrame, offset_s: int, ticket: int | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Broker orders or deals with ``us``, the first of four time fields that is there, in UTC.

    ``time_msc`` is in milliseconds, the others in seconds; zero counts as missing. Limits are
    inclusive; rows without a time pass only where none is set.
    """
    if ticket is not None and ticket <= 0:
        raise ValueError("a ticket is a positive number")
    if start_us is not None and end_us is not None and start_us > end_us:
        raise ValueError("a range must not end before it starts")
    seconds = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("time", "time_setup", "time_done")])
    out = rows.withColumn("us", epoch_us(seconds, F.col("time_msc"), offset_s))
    for test in ([F.col("ticket") == ticket] if ticket is not None else []) + ([F.col("us") >= start_us] if start_us is not None else []) + ([F.col("us") <= end_us] if end_us is not None else []):
        out = out.where(test)
    return out


def markets(pages: DataFrame, column: str = "body") -> DataFrame:
    """One row for each market nested in the events of a vendor's JSON answer."""
    kind = "struct<events:array<struct<title:string,markets:array<struct<question:string,closed:boolean,endDate:string,outcomePrices:string,outcomes:string,volumeNum:double>>>>>"
    events = pages.select(F.posexplode(F.from_json(column, kind)["events"]).alias("event", "e"))
    rows = events.select("event", F.posexplode("e.markets").alias("place", "m"))
    return rows.select("event", "place", "m.question", "m.closed", F.unix_micros(F.try_to_timestamp("m.endDate")).alias("end_us"), F.col("m.outcomePrices").alias("prices"), "m.outcomes", F.col("m.volumeNum").alias("volume"))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256) of the files below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def distinct_sources(files: DataFrame) -> DataFrame:
    """The first path of each content: byte-identical sources count once."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, if it names the same paths with the same contents as ``before``; else an error."""
    both = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer").where("not a <=> b")
    if moved := [r.path for r in both.select("path").orderBy("path").limit(5).collect()]:
        raise RuntimeError(f"sources changed while they were read: {', '.join(moved)}")
    return after


def inventory_changes(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): NEW, CHANGED, SAME or REMOVED against the inventory kept from the last time."""
    both = found.select("path", F.col("sha256").alias("a")).join(known.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.select("path", F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME").alias("change"))


def quarantined(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without a reason, and those with one and its name in ``reason``: two sinks, no row lost."""
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def merged_import(source: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source_id, decision_id, outcome): what importing rows into a catalog of aliases does.

    Same fingerprint and a current alias: UNCHANGED; nothing known: INDEXED; known from another
    source with the same fingerprint: ALIAS; another fingerprint: QUARANTINED; a current alias of a
    source that no longer has the row: REMOVED.
    """
    # names of a source being imported; aliases of other sources stay as they are
    sources = source.select("source_id").distinct()
    known = catalog.groupBy("decision_id").agg(F.min("fingerprint").alias("known"))
    mine = catalog.select("source_id", "decision_id", F.col("state").alias("state"))
    rows = source.join(known, "decision_id", "left").join(mine, ["source_id", "decision_id"], "left")
    outcome = F.when(F.col("known").isNull(), "INDEXED").when(F.col("known") != F.col("fingerprint"), "QUARANTINED").when(F.col("state") == "CURRENT", "UNCHANGED").otherwise("ALIAS")
    gone = catalog.where("state = 'CURRENT'").join(sources, "source_id", "left_semi").join(source.select("source_id", "decision_id"), ["source_id", "decision_id"], "left_anti")
    return rows.select("source_id", "decision_id", outcome.alias("outcome")).unionByName(gone.select("source_id", "decision_id", F.lit("REMOVED").alias("outcome")))


def findings(experiences: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of live experiences of tier A or B that aren't known yet."""
    rows = experiences.where("tombstoned = 0 and tier in ('A', 'B')").select(F.concat(F.lit("observation-"), F.col("experience_id").cast("string")).alias("finding_id"), "experience_id", "symbol", "tier")
    return rows.join(known.select("finding_id"), "finding_id", "left_anti")


def missing_vectors(wanted: DataFrame, cached: DataFrame, spec: str) -> DataFrame:
    """Documents without a cached vector of this very spec; vectors of other specs don't count."""
    return wanted.join(cached.where(F.col("spec") == spec).select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")


def write_vectors(vectors: DataFrame, path: str, dims: int) -> None:
    """A vector table for search, refused if a row has another number of dimensions or a bad number."""
    bad = vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dims) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if bad.limit(1).count():
        raise ValueError(f"vectors must have {dims} finite numbers")
    vectors.write.mode("errorifexists").parquet(path)


def safe_map(column: str) -> Column:
    """The entries of a map of text whose key and value have no sensitive word."""
    return F.map_filter(column, lambda k, v: ~k.rlike(SENSITIVE) & ~F.coalesce(v.rlike(SENSITIVE), F.lit(False)))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any: an ordered chain of vendors."""
    for rows in sources[:-1]:
        if rows.limit(1).count():
            return rows
    return sources[-1]


def agent_metrics(runs: DataFrame, column: str = "metrics_json") -> DataFrame:
    """Telemetry by agent out of a JSON map in each run; damaged numbers count as nothing."""
    kind = "struct<agents:map<string,struct<model:string,calls:string,tokens_in:string,tokens_out:string,elapsed_seconds:string>>>"
    rows = runs.select(F.explode(F.from_json(column, kind)["agents"]).alias("name", "m")).withColumn("agent", F.substring(F.trim("name"), 1, 120)).where("agent <> '' and m is not null")
    whole = lambda c: F.sum(F.expr(f"if(try_cast(m.{c} as bigint) >= 0, try_cast(m.{c} as bigint), 0)")).alias(c)
    elapsed = F.expr("case when try_cast(m.elapsed_seconds as double) >= 0 and not isnan(try_cast(m.elapsed_seconds as double)) then try_cast(m.elapsed_seconds as double) end")
    rows = rows.withColumn("s", elapsed).withColumn("model", F.substring(F.trim("m.model"), 1, 160))
    return rows.groupBy("agent").agg(
        F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))), ",").alias("models"), whole("calls"), whole("tokens_in"), whole("tokens_out"),
        F.round(F.avg("s"), 6).alias("mean_s"), F.round(F.percentile("s", F.lit(0.5)), 6).alias("median_s"), F.round(F.percentile("s", F.lit(0.95)), 6).alias("p95_s"), F.max("s").alias("most_s"),
    )


def rule_mapping(claimed: DataFrame, implemented: DataFrame) -> DataFrame:
    """(strategy, component, status, matched): claimed rule signatures against those a component has.

    All of a component's signatures claimed: MATCHED; some: PARTIALLY_MATCHED; none: NO_DIRECT_MATCH.
    """
    hit = implemented.distinct().join(claimed.select("strategy", "signature").distinct().withColumn("hit", F.lit(1)), ["strategy", "signature"], "left")
    out = hit.groupBy("strategy", "component").agg(F.count("*").alias("rules"), F.count("hit").alias("matched"))
    status = F.when(F.col("matched") == 0, "NO_DIRECT_MATCH").when(F.col("matched") == F.col("rules"), "MATCHED").otherwise("PARTIALLY_MATCHED")
    return out.select("strategy", "component", status.alias("status"), "matched")


def discovery(hits: DataFrame) -> DataFrame:
    """(doc_id, references, best_rank, refs): the hits of a bank of queries, once for each document."""
    line = F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("references"), F.min("rank").alias("best_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", line.alias("line")))), lambda x: x["line"]), ",").alias("refs"))


def bundle(parts: dict[str, DataFrame | None], required: tuple[str, ...] = ()) -> tuple[str, dict[str, str]]:
    """The status of an evidence bundle and of each part: AVAILABLE, EMPTY or UNAVAILABLE (None).

    COMPLETE if all parts are there, UNAVAILABLE if a required one isn't, else PARTIAL.
    """
    states = {name: "UNAVAILABLE" if rows is None else "AVAILABLE" if rows.limit(1).count() else "EMPTY" for name, rows in parts.items()}
    if any(states.get(name) != "AVAILABLE" for name in required):
        return "UNAVAILABLE", states
    return ("COMPLETE" if all(s == "AVAILABLE" for s in states.values()) else "PARTIAL"), states


def canonical(rows: DataFrame, identity: list[str], parts: dict[str, list[str]], *kept: str) -> DataFrame:
    """Training examples: an id from the identity, and the named columns of each part as one JSON text; ``kept`` columns stay.

    Rows without a full identity are refused as a whole: eligible rows have one.
    """
    known = F.array_join(F.array(*[F.col(c).cast("string") for c in identity]), "\x1f")
    whole = F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in identity]), True), F.raise_error(F.lit("an example has no full identity"))).otherwise(known)
    return rows.select(F.concat(F.lit("ex_"), F.sha2(whole.cast("binary"), 256)).alias("example_id"), *[F.to_json(F.struct(*columns)).alias(name) for name, columns in parts.items()], *kept)


def built_dataset(rows: DataFrame, key: list[str], group: list[str], at: str) -> DataFrame:
    """Eligible observations, the first of each key, with the split of their group.

    ``rows`` have ``reasons`` (see gates.dataset_reasons); groups are whole and in time order.
    """
    from tidemark.operators.order import chronological_group_split

    good = rows.where("size(reasons) = 0")
    first = good.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(at, *group))).where("rank = 1").drop("rank")
    return first.join(chronological_group_split(first, group, at).select(*group, "split"), group)
