"""The dataset build: pairing against a loop, marked duplicates, isolated sources, verified generations."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset
from tidemark.sources import files

rng = random.Random(11)
EVALS = "id bigint, decision_id bigint, basis string, horizon_s bigint, status string, fingerprint string, known_us bigint"
SNAPS = "decision_id bigint, basis string, horizon_s bigint, status string, fingerprint string, observed_us bigint"


def facts(n, decisions):
    time = lambda: rng.choice([None, *range(0, 100, 7)])
    some = lambda: (rng.randrange(decisions), rng.choice("AB"), rng.choice([60, 3600]), rng.choice(["COMPLETE", "PENDING", "GONE"]), rng.choice(["x", "y", "z", None]), time())
    return [(i, *some()) for i in range(n)], [some() for _ in range(n)]


def best(e, snaps):
    own = [s for s in snaps if s[:3] == e[1:4]]
    found = [s for s in own if e[5] is not None and s[4] == e[5]] or [s for s in own if s[3] == e[4]] or own
    if e[6] is not None:
        found = [s for s in found if s[5] is None or s[5] <= e[6]] or found
    return max(((s[5] is not None, s[5] or 0, s[4] is not None, s[4] or "") for s in found), default=None)


@pytest.mark.parametrize("decisions,width", [(1, 10), (5, 1000), (40, 3)])
def test_pairing_against_a_loop(spark, decisions, width):
    evals, snaps = facts(200, decisions)
    found = dataset.paired(spark.createDataFrame(evals, EVALS).repartition(3), spark.createDataFrame(snaps, SNAPS), ["decision_id", "basis", "horizon_s"], "id", width)
    got = {r.id: (r.snapshot_us, r.snapshot_fp) for r in found.collect()}
    want = {e[0]: (None, None) if (b := best(e, snaps)) is None else (b[1] if b[0] else None, b[3] if b[2] else None) for e in evals}
    assert got == want


@pytest.mark.parametrize("hot", [0, 150])
def test_large_keys_are_paired_in_buckets_of_time(spark, hot):
    """Keys of very many rows go by lanes, the others in one shuffle: the same pairs, and none without a key or an id."""
    evals, snaps = facts(200, 1)
    few, fewer = facts(60, 5000)
    evals = [*evals, *[(1000 + i, 7 + e[1], *e[2:]) for i, e in enumerate(few)], (2000, None, "A", 60, "COMPLETE", "x", 5), (None, 0, "A", 60, "COMPLETE", "x", 5)]
    snaps = [*snaps, *[(7 + s[0], *s[1:]) for s in fewer], (None, "A", 60, "COMPLETE", "x", 1)]
    found = dataset.paired(spark.createDataFrame(evals, EVALS), spark.createDataFrame(snaps, SNAPS), ["decision_id", "basis", "horizon_s"], "id", 10, hot)
    got = {r.id: (r.snapshot_us, r.snapshot_fp) for r in found.collect()}
    want = {e[0]: (None, None) if e[0] is None or e[1] is None or (b := best(e, snaps)) is None else (b[1] if b[0] else None, b[3] if b[2] else None) for e in evals}
    assert got == want


def test_facts_are_dealt_once(spark):
    """Pairs and observations: rows pass one exchange by their decision, not one for each lane and join."""
    evals, snaps = facts(20, 3)
    found = dataset.paired(spark.createDataFrame(evals, EVALS), spark.createDataFrame(snaps, SNAPS), ["decision_id", "basis", "horizon_s"], "id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pairing_never_multiplies(spark):
    """One decision with n evaluations and n snapshots: rows of the scan grow with their sum."""
    evals, snaps = facts(300, 1)
    found = dataset.paired(spark.createDataFrame(evals, EVALS), spark.createDataFrame(snaps, SNAPS), ["decision_id", "basis", "horizon_s"], "id", 1000)
    assert found.count() == 300
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def joined(spark, decisions, records, evals, snaps, audits):
    frames = [
        spark.createDataFrame(decisions, "decision_id bigint, run_id string, fp string, copy int"), spark.createDataFrame(records, "decision_id bigint, run_id string, fp string, copy int"),
        spark.createDataFrame(evals, "eval_id string, decision_id bigint, run_id string, fp string, basis string, horizon_s bigint, status string, fingerprint string, known_us bigint"),
        spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(audits, "decision_id bigint, run_id string, copy int"),
    ]
    return {(r.decision_id, r.run_id): r for r in dataset.joined(*frames, {k: ["copy"] for k in ("decisions", "records", "audits")}).collect()}


def test_what_repeats_is_marked_and_multiplies_nothing(spark):
    rows = joined(
        spark,
        [(1, "r", "f", 0), (1, "r", "f", 1), (2, "r", "f", 0), (3, "r", "f", 0), (4, "r", None, 0), (5, "r", "f", 0)],
        [(2, "r", "f", 0), (2, "r", "f", 1), (3, "other", "f", 0), (5, "r", "f", 0)],
        [("a", 5, None, None, "A", 60, "C", "y", 10), ("b", 5, "r", "f", "A", 60, "C", "x", 10), ("c", 5, "q", None, "A", 60, "C", "w", 10), ("d", 5, None, None, "B", 60, "C", "v", 10), ("e", 3, None, "other", "A", 60, "C", "v", 10)],
        [(5, "A", 60, "C", "s", 5), (3, "A", 60, "C", "s", 5)],
        [(4, "r", 0), (4, "r", 1), (5, "r", 0)],
    )
    assert len(rows) == 5
    assert {k[0]: r.duplicate for k, r in rows.items()} == {1: True, 2: True, 3: False, 4: True, 5: True}
    five = rows[5, "r"]
    assert [(e.basis, e.eval_id, e.n, e.snapshot_fp) for e in five.evaluations] == [("A", "b", 2, "s"), ("B", "d", 1, None)]
    assert five.duplicate_evaluations == ["5:A:60"] and not five.repeated
    assert rows[3, "r"].record is None and rows[3, "r"].evaluations is None and rows[4, "r"].audit.copy == 0


def test_sources_are_isolated(spark, tmp_path):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 no parquet PAR1")
    readers = {
        "a": lambda: good, "B": lambda: good.orderBy(F.desc("k")).repartition(3), "lacks": lambda: good.drop("v"), "gone": lambda: spark.read.parquet(str(tmp_path / "none")),
        "damaged": lambda: spark.read.schema("k bigint, v string").parquet(str(tmp_path / "bad")), "more": lambda: good.where("k = 1").withColumn("extra", F.lit(1)),
    }
    rows, bad, states = dataset.united(readers, ["k", "v"])
    assert sorted((r.k, r.source) for r in rows.collect()) == [(1, "a"), (1, "more"), (2, "a")]
    assert {k: v.split(":")[0] for k, v in states.items()} == {"a": "READ", "B": "DUPLICATE", "lacks": "BROKEN", "gone": "BROKEN", "damaged": "BROKEN", "more": "READ"}
    assert {r.decision_id for r in bad.collect()} == {"source:B", "source:lacks", "source:gone", "source:damaged"}
    assert dataset.united({}, ["k"])[0] is None


def test_the_first_of_a_key_stands_for_it(spark):
    rows = spark.createDataFrame([(i, f"k{i % 20}", f"g{i % 20}", i, ["BAD"] if i == 1 else []) for i in range(40)], "id bigint, key string, g string, at bigint, reasons array<string>")
    good, left = dataset.classified(rows, ["key"], ["g"], "at", "id")
    assert {r.id for r in good.collect()} == {0, *range(2, 20)} and {r.split for r in good.collect()} == {"train", "validation", "test"}
    assert {(r.id, r.reasons) for r in left.collect()} == {("1", "BAD")} | {(str(i), "DUPLICATE") for i in range(20, 40)}


def test_generations_are_verified(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "train" if i % 3 else "test") for i in range(30)], "id bigint, text string, split string")
    files.write_generation(rows, str(tmp_path / "g"))
    again = spark.read.schema(rows.schema).json(str(tmp_path / "g"))
    assert files.verified(rows, again).count() == 30
    with pytest.raises(RuntimeError, match="train"):
        files.verified(rows, again.where("id <> 4"))
    with pytest.raises(RuntimeError, match="test"):
        files.verified(rows, again.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text"))))
