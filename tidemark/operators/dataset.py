"""The dataset build: sources united, three kinds of facts joined, evaluations paired, examples split and written.

No side is joined many to many. What may repeat is reduced to its first row and a count before it meets
another side, so a repeated identity is *marked* and multiplies nothing. Evaluations meet snapshots in
lanes (same fingerprint, same status, any), and in each lane one scan over the time carries the latest
snapshot known at the evaluation; a decision with many of both costs their sum, not their product.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.order import chronological_group_split

EARLIEST, LATEST = -(1 << 62), 1 << 62
DAY_US = 86_400_000_000
EVALUATION = ["basis", "horizon_s"]
#: Shares of keys that are counted, and when one is too large for a task: rows, and times the mean.
BINS, HOT, SKEW = 1 << 14, 1 << 20, 16


def united(readers: dict[str, Callable[[], DataFrame]], required: list[str]) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """Rows of all good sources with their ``source``; exclusions; and the state of each source.

    A source that can't be opened, lacks a column or breaks while it is read is BROKEN and harms no
    other; one whose rows are those of an earlier one, in any order, is a DUPLICATE. Sources are few;
    each is read by a job of its own, of which one row comes to the driver.
    """
    good, states, seen = [], {}, {}
    for name in sorted(readers, key=str.casefold):
        try:
            rows = readers[name]()
            if missing := [c for c in required if c not in rows.columns]:
                raise ValueError(f"columns missing: {', '.join(missing)}")
            rows = rows.select(*required)
            mark = rows.agg(F.count("*"), F.sum(F.xxhash64(*required).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), *required).cast("decimal(38,0)"))).first()
        except (PySparkException, Py4JJavaError, ValueError) as error:
            states[name] = f"BROKEN: {type(error).__name__}"
            continue
        if tuple(mark) in seen:
            states[name] = f"DUPLICATE: {seen[tuple(mark)]}"
            continue
        seen[tuple(mark)] = name
        states[name] = "READ"
        good.append(rows.withColumn("source", F.lit(name)))
    out = None
    for rows in good:
        out = rows if out is None else out.unionByName(rows)
    bad = [(f"source:{n}", "DUPLICATE" if s.startswith("DUPLICATE") else "SOURCE_INTEGRITY_FAILED") for n, s in states.items() if s != "READ"]
    spark = SparkSession.active()
    return out, spark.createDataFrame(bad, "decision_id string, reason string") if bad else None, states


def paired(evaluations: DataFrame, snapshots: DataFrame, key: list[str], id: str | list[str], width_us: int = DAY_US, hot: int = HOT) -> DataFrame:
    """The evaluations with ``snapshot_fp`` and ``snapshot_us``, those of the snapshot that goes with each.

    Of snapshots of the same key those of the same fingerprint count, if there are none those of the
    same status, else all; of these the ones observed by ``known_us`` if any is, and the latest, of
    equal times the one of the greatest fingerprint. A snapshot without a time counts as known, and as
    the earliest; an evaluation without one knows all. ``id`` tells evaluations apart, those without one get none.

    Rows are dealt once, by the first column of the key. Keys whose share of ``BINS`` holds more than
    ``hot`` rows and many times the mean are scanned in lanes of buckets of time instead, in as many
    tasks as they have buckets.
    """
    ids = [id] if isinstance(id, str) else id
    bin = F.pmod(F.xxhash64(key[0]), F.lit(BINS)).alias("bin_")
    held = evaluations.select(bin).unionByName(snapshots.select(bin)).groupBy("bin_").agg(F.count("*").alias("n"))
    held = held.withColumn("all_", F.sum("n").over(Window.partitionBy()))  # a row for each bin
    names = [r.bin_ for r in held.where((F.col("n") > hot) & (F.col("n") * BINS > F.col("all_") * SKEW)).select("bin_").collect()]
    if not names:
        return _dealt(evaluations, snapshots, key, ids)
    sides = lambda rows, much: rows.where(bin.isin(names) if much else ~bin.isin(names))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key], F.lit(True)) & F.col(ids[0]).isNotNull()
    wide = sides(evaluations, True).withColumn("tells_", F.when(known, F.to_json(F.struct(*ids))))
    return _dealt(sides(evaluations, False), sides(snapshots, False), key, ids).unionByName(_in_lanes(wide, sides(snapshots, True), key, "tells_", width_us).drop("tells_"))


def _dealt(evaluations: DataFrame, snapshots: DataFrame, key: list[str], ids: list[str]) -> DataFrame:
    """``paired`` by windows over whole keys: one shuffle, and a sort inside the tasks for each lane."""
    row = F.struct(*evaluations.columns)
    pick = F.struct(F.coalesce("observed_us", F.lit(EARLIEST)).alias("at"), F.col("fingerprint").alias("fp"), F.col("observed_us").alias("us"))
    of = [F.col(c).alias(f"{c}_") for c in key]
    tags = [F.col("fingerprint").alias("tag0_"), F.col("status").alias("tag1_")]
    asked = evaluations.select(*of, *tags, F.coalesce("known_us", F.lit(LATEST)).alias("at_"), F.lit(True).alias("asks_"), row.alias("row_"))
    theirs = snapshots.select(*of, *tags, F.coalesce("observed_us", F.lit(EARLIEST)).alias("at_"), F.lit(False).alias("asks_"), pick.alias("pick_"))
    line = [f"{c}_" for c in key]
    both = theirs.unionByName(asked, allowMissingColumns=True).repartition(line[0])
    lanes = []
    for lane, tag in enumerate((["tag0_"], ["tag1_"], [])):
        w = Window.partitionBy(*line, *tag).orderBy("at_", "asks_")
        best, top = F.max("pick_").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("pick_").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        both = both.withColumns({f"best{lane}_": best, f"top{lane}_": top})
        lane_pick = F.coalesce(f"best{lane}_", f"top{lane}_")
        lanes.append(F.when(F.col(tag[0]).isNotNull(), lane_pick) if tag else lane_pick)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*line, f"row_.{ids[0]}")])
    found = both.where("asks_").select("row_.*", F.when(whole, F.coalesce(*lanes)).alias("pick_"))
    return found.select(*evaluations.columns, F.col("pick_.fp").alias("snapshot_fp"), F.col("pick_.us").alias("snapshot_us"))


def _in_lanes(evaluations: DataFrame, snapshots: DataFrame, key: list[str], id: str, width_us: int) -> DataFrame:
    """``paired`` by one scan over buckets of time in each lane, for keys of very many rows."""
    lanes = lambda fp, status: F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), tag.alias("tag")) for i, tag in enumerate((fp, status, F.lit("")))])).alias("in")
    pick = F.struct(F.coalesce("observed_us", F.lit(EARLIEST)).alias("at"), F.col("fingerprint").alias("fp"), F.col("observed_us").alias("us"))
    of = [F.col(c).alias(f"{c}_") for c in key]
    theirs = snapshots.select(*of, pick.alias("pick"), lanes(F.col("fingerprint"), F.col("status"))).select(*[f"{c}_" for c in key], "in.*", F.col("pick.at").alias("at"), F.lit(None).cast(evaluations.schema[id].dataType).alias("id_"), "pick")
    asked = evaluations.select(*of, F.coalesce("known_us", F.lit(LATEST)).alias("at"), F.col(id).alias("id_"), lanes(F.col("fingerprint"), F.col("status"))).select(*[f"{c}_" for c in key], "in.*", "at", "id_", F.lit(None).cast(theirs.schema["pick"].dataType).alias("pick"))
    line = [*[f"{c}_" for c in key], "lane", "tag"]
    both = theirs.unionByName(asked).where("tag is not null").withColumn("asks", F.col("id_").isNotNull())
    known = scans.greatest_before(both, line, ["at", "asks"], scans.span("at", width_us), {"best": F.col("pick")}).where("asks")
    latest = theirs.groupBy(*[F.col(c).alias(f"{c}of") for c in line]).agg(F.max("pick").alias("top"))
    on = known[line[0]].eqNullSafe(latest[f"{line[0]}of"])
    for c in line[1:]:
        on = on & known[c].eqNullSafe(latest[f"{c}of"])
    found = known.join(latest, on).select("id_", "lane", F.coalesce("best", "top").alias("pick"))
    first = found.groupBy("id_").agg(F.min_by("pick", "lane").alias("pick"))
    return evaluations.join(first, evaluations[id] == first["id_"], "left").drop("id_").withColumns({"snapshot_fp": F.col("pick.fp"), "snapshot_us": F.col("pick.us")}).drop("pick")


def joined(decisions: DataFrame, records: DataFrame, evaluations: DataFrame, snapshots: DataFrame, audits: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """A row for each (decision_id, run_id, fp): ``decision``, ``record``, ``audit``, ``evaluations`` and what repeats.

    Evaluations are those of the decision whose own run and fingerprint, where they have them, are the
    decision's; they are paired with the snapshots of the record. Of evaluations of one basis and
    horizon the first by fingerprint is kept and the key is listed in ``duplicate_evaluations``.
    ``orders`` says for decisions, records and audits by which columns the first one is told.
    """
    identity, run = ["decision_id", "run_id", "fp"], ["decision_id", "run_id"]
    base = _facts(decisions, records, audits, orders)
    ids = decisions.select(*identity, F.lit(True).alias("decided"), F.lit(False).alias("recorded")).unionByName(records.select(*identity, F.lit(False).alias("decided"), F.lit(True).alias("recorded")))
    ids = ids.groupBy(*identity).agg(F.max("decided").alias("decided"), F.max("recorded").alias("recorded")).where("decided").drop("decided")
    named = evaluations.select(*[F.col(c).alias({"run_id": "own_run", "fp": "own_fp"}.get(c, c)) for c in ("decision_id", "run_id", "fp", *EVALUATION, "fingerprint", "status", "known_us", "eval_id")])
    theirs = named.join(ids, "decision_id").where((F.col("own_run").isNull() | (F.col("own_run") == F.col("run_id"))) & (F.col("own_fp").isNull() | (F.col("own_fp") == F.col("fp"))))
    one = theirs.groupBy(*identity, *EVALUATION).agg(F.min_by(F.struct("fingerprint", "status", "known_us", "eval_id"), F.struct("fingerprint", "eval_id")).alias("e"), F.count("*").alias("n"), F.max("recorded").alias("recorded"))
    one = one.select(*identity, *EVALUATION, "e.*", "n", "recorded")
    own = paired(one, snapshots, ["decision_id", *EVALUATION], [*EVALUATION, *identity])
    one = own.withColumns({c: F.when(F.col("recorded"), F.col(c)) for c in ("snapshot_fp", "snapshot_us")})
    item = F.struct(*EVALUATION, "fingerprint", "status", "known_us", "eval_id", "snapshot_fp", "snapshot_us", "n")
    listed = one.groupBy(*identity).agg(F.array_sort(F.collect_list(item)).alias("evaluations"))  # one for each basis and horizon
    out = _left(base, listed, identity)
    again = F.transform(F.filter("evaluations", lambda e: e["n"] > 1), lambda e: F.concat_ws(":", F.col("decision_id").cast("string"), e["basis"], e["horizon_s"].cast("string")))
    repeated = (F.col("decision_n") > 1) | (F.coalesce("record_n", F.lit(0)) > 1) | (F.coalesce("audit_n", F.lit(0)) > 1)
    out = out.withColumns({"duplicate_evaluations": F.coalesce(again, F.array().cast("array<string>")), "repeated": repeated})
    return out.withColumn("duplicate", F.col("repeated") | (F.size("duplicate_evaluations") > 0))


def _facts(decisions: DataFrame, records: DataFrame, audits: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """The first row of decisions of each identity, with those of its records and audits, and how many there are.

    All are dealt once, by the decision; audits stand beside the identity without a fingerprint until
    a scan over the run gives them to all of its decisions.
    """
    identity, run = ["decision_id", "run_id", "fp"], ["decision_id", "run_id"]
    sides, kinds = None, {"decision": decisions, "record": records, "audit": audits}
    for name, rows in kinds.items():
        key = run if name == "audit" else identity
        first = F.struct(F.struct(*orders[f"{name}s"]).alias("by"), F.struct(*[c for c in rows.columns if c not in key]).alias("row"))
        named = rows.select(*key, *([F.lit(None).cast(decisions.schema["fp"].dataType).alias("fp")] if name == "audit" else []), first.alias(f"{name}_"))
        sides = named if sides is None else sides.unionByName(named, allowMissingColumns=True)
    one = sides.repartition("decision_id").groupBy(*identity).agg(*[c for n in kinds for c in (F.min_by(F.col(f"{n}_.row"), F.col(f"{n}_.by")).alias(n), F.count(f"{n}_").alias(f"{n}_n"))])
    whole = Window.partitionBy(*run)
    one = one.withColumns({"audit": F.first("audit", ignorenulls=True).over(whole), "audit_n": F.max("audit_n").over(whole)}).where("decision_n > 0")
    return one.withColumns({f"{n}_n": F.nullif(F.col(f"{n}_n"), F.lit(0)) for n in ("record", "audit")})


def _left(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Left join on equal or both null names."""
    other = b.withColumnsRenamed({n: f"{n}__" for n in names})
    on = a[names[0]].eqNullSafe(other[f"{names[0]}__"])
    for n in names[1:]:
        on = on & a[n].eqNullSafe(other[f"{n}__"])
    return a.join(other, on, "left").drop(*[f"{n}__" for n in names])


def evaluated(rows: DataFrame, basis: str, horizon_s: int) -> DataFrame:
    """The joined rows with the evaluation asked for, or the first one: ``eval`` and ``duplicate`` for this one only."""
    wanted = F.filter("evaluations", lambda e: (e["basis"] == basis) & (e["horizon_s"] == horizon_s))
    chosen = F.coalesce(F.get(wanted, F.lit(0)), F.get("evaluations", F.lit(0)))
    return rows.withColumn("eval", chosen).withColumn("duplicate", F.col("repeated") | F.coalesce(F.col("eval.n") > 1, F.lit(False)))


def classified(rows: DataFrame, key: list[str], group: list[str], at: str, identity: str) -> tuple[DataFrame, DataFrame]:
    """Examples with their split, and (identity, reasons) of what is left out.

    ``rows`` have ``reasons``. The first row of each key stands for it, eligible or not; later ones are
    left out as DUPLICATE. Groups are split whole, in time order.
    """
    line = Window.partitionBy(*key).orderBy(at, *group, identity)
    placed = rows.withColumn("place_", F.row_number().over(line))
    first = placed.where("place_ = 1").drop("place_")
    good = first.where("size(reasons) = 0")
    splits = chronological_group_split(good, group, at).select(*group, "split")
    left = first.where("size(reasons) > 0").select(F.col(identity).cast("string").alias(identity), F.array_join("reasons", ",").alias("reasons"))
    again = placed.where("place_ > 1").select(F.col(identity).cast("string").alias(identity), F.lit("DUPLICATE").alias("reasons"))
    return good.join(splits, group), left.unionByName(again)

