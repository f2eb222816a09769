"""SQLite tables and the registry of sources."""

import hashlib
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import dataset
from tidemark.sources import registry, sqlite


@pytest.fixture
def db(tmp_path):
    path = tmp_path / "a b.sqlite"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE decisions (id INTEGER PRIMARY KEY, symbol TEXT, price REAL, body BLOB, odd)")
        c.executemany("INSERT INTO decisions VALUES (?, ?, ?, ?, ?)", [(i, f"S{i % 5}", "n/a" if i % 7 == 0 else i / 2, None if i % 3 else b"x", str(i)) for i in range(1, 1001)])
        c.execute("CREATE TABLE pairs (a TEXT, b INTEGER, PRIMARY KEY (a, b)) WITHOUT ROWID")
        c.executemany("INSERT INTO pairs VALUES (?, ?)", [("x", 1), ("y", 2)])
        c.execute('CREATE TABLE "no ""rows" (v REAL)')
    return str(path)


def test_tables_are_read_in_ranges(spark, db):
    before = hashlib.sha256(open(db, "rb").read()).hexdigest()
    rows = sqlite.table(spark, db, "decisions", ("id", "symbol"), partitions=4)
    assert rows.dtypes == [("id", "bigint"), ("symbol", "string"), ("price", "double"), ("body", "binary"), ("odd", "string")]
    assert rows.rdd.getNumPartitions() == 4
    got = {r.id: r for r in rows.collect()}
    assert len(got) == 1000 and got[7].price is None and got[8].price == 4.0 and bytes(got[3].body) == b"x" and got[4].body is None and got[5].odd == "5"
    assert {(r.a, r.b) for r in sqlite.table(spark, db, "pairs").collect()} == {("x", 1), ("y", 2)}
    assert sqlite.table(spark, db, 'no "rows').collect() == []
    assert hashlib.sha256(open(db, "rb").read()).hexdigest() == before


def test_filters_narrow_what_is_read(spark, db):
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = sqlite.table(spark, db, "decisions", partitions=4)
        some = rows.where((F.col("id") > 900) & (F.col("id") <= 902))
        assert {r.id for r in some.collect()} == {901, 902} and some.rdd.getNumPartitions() == 2  # a range for each id that is left
        assert rows.where("id = -1").rdd.getNumPartitions() == 1 and rows.where("id = -1").count() == 0
        assert rows.where("symbol in ('S1', 'S2') and price >= 100 and odd like '%1'").count() == sum(1 for i in range(1, 1001) if i % 5 in (1, 2) and i % 7 and i / 2 >= 100 and str(i).endswith("1"))
        assert rows.where("price is null").count() == sum(1 for i in range(1, 1001) if i % 7 == 0)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled") if old is None else spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_what_is_missing_fails_at_once(spark, db, tmp_path):
    (tmp_path / "no.sqlite").write_bytes(b"this is no database" * 100)
    for path, name, required in ((db, "decisions", ("gone",)), (db, "nowhere", ()), (str(tmp_path / "no.sqlite"), "t", ()), (str(tmp_path / "absent"), "t", ())):
        with pytest.raises(PySparkException):
            sqlite.table(spark, path, name, required)
    readers = {"good": lambda: sqlite.table(spark, db, "decisions"), "lacks": lambda: sqlite.table(spark, db, "pairs", ("id",)), "damaged": lambda: sqlite.table(spark, str(tmp_path / "no.sqlite"), "decisions")}
    rows, _, states = dataset.united(readers, ["id", "symbol"])
    assert rows.count() == 1000 and {k: v.split(":")[0] for k, v in states.items()} == {"good": "READ", "lacks": "BROKEN", "damaged": "BROKEN"}


def test_chains_of_sources(spark, db):
    bars = registry.Registry()
    frame = lambda n: spark.range(n).selectExpr("id", "concat('S', id) as symbol")
    bars.register("bars", "empty", lambda symbol: frame(0), ("id",))
    bars.register("bars", "broken", lambda symbol: spark.read.parquet("/nowhere/at/all"))
    bars.register("bars", "bare", lambda symbol: frame(3).select("id"), ("id", "symbol"))
    bars.register("bars", "sqlite", lambda symbol: sqlite.table(spark, db, "decisions").where(F.col("symbol") == symbol), ("id", "symbol"))
    bars.register("bars", "late", lambda symbol: frame(5))
    found = bars.read("bars", symbol="S3")
    assert found.source == "sqlite" and found.rows.count() == 200
    assert [(p.source, p.kind) for p in found.passed] == [("empty", "EMPTY"), ("broken", "BROKEN"), ("bare", "INCOMPLETE")]
    assert bars.read("bars", ["late", "sqlite"], symbol="S3").source == "late"
    with pytest.raises(registry.NothingFound) as none:
        bars.read("bars", ["nobody", "empty"], symbol="S3")
    assert [(r.source, r.kind) for r in none.value.reasons] == [("nobody", "UNKNOWN"), ("empty", "EMPTY")]
    with pytest.raises(registry.NothingFound):
        bars.read("news")
    with pytest.raises(ValueError):
        bars.register("bars", "late", lambda: frame(1))
