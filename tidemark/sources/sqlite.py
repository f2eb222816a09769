"""SQLite tables as a Spark data source: read only, in ranges of row ids, with filters sent to the database.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", p).option("table", "decisions").option("required", "id,at").load()

The file lies where all executors reach it and is opened with ``mode=ro`` and ``query_only``, so nothing
is ever written, not even a journal. Filters only narrow what is read: Spark applies them again, since
SQLite's columns may hold values of any kind. A value that isn't of its column's kind is null.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

FETCHED = 10_000
# Kinds of columns by the words of their declaration, as SQLite tells them.
KINDS = [("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType())]
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
PLAIN = {LongType: (int,), DoubleType: (int, float), StringType: (str,), BinaryType: (bytes,)}


class MissingColumns(ValueError):
    """A source without columns that its reader needs."""


def opened(path: str) -> sqlite3.Connection:
    connection = sqlite3.connect(f"file:{quote(re.sub('^file:/*', '/', path))}?mode=ro", uri=True)
    connection.execute("PRAGMA query_only = ON")
    return connection


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    """Row ids from ``lo`` to ``hi``; all rows of a table that has none."""

    lo: int | None
    hi: int | None


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with closing(opened(self.options["path"])) as db:
            columns = db.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        if not columns:
            raise MissingColumns(f"no table {self.options['table']}")
        out = StructType()
        for _, name, declared, *_ in columns:
            out.add(name, next((kind for word, kind in KINDS if word in declared.upper()), StringType()))
        required = [c for c in self.options.get("required", "").split(",") if c]
        if missing := [c for c in required if c not in out.names]:
            raise MissingColumns(f"columns missing: {', '.join(missing)}")
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if self.options.get("pushed") == "true" else SqliteReader)(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.partitions_wanted = int(options.get("partitions", "8"))
        self.tests, self.values = [], []

    def _where(self, *more: str) -> str:
        tests = [*self.tests, *more]
        return " WHERE " + " AND ".join(tests) if tests else ""

    def partitions(self) -> list[Rows]:
        with closing(opened(self.path)) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}{self._where()}", self.values).fetchone()
            except sqlite3.OperationalError:  # a table WITHOUT ROWID
                return [Rows(None, None)]
        if lo is None:
            return [Rows(1, 0)]  # Spark takes none for one without a range
        step = max(1, -(-(hi - lo + 1) // self.partitions_wanted))
        return [Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(_named(c) for c in self.schema.names)
        ranged = () if partition.lo is None else ("rowid BETWEEN ? AND ?",)
        values = [*self.values, *(() if partition.lo is None else (partition.lo, partition.hi))]
        kinds = [PLAIN[type(f.dataType)] for f in self.schema]
        types = [{LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary()}[type(f.dataType)] for f in self.schema]
        with closing(opened(self.path)) as db:
            found = db.execute(f"SELECT {columns} FROM {_named(self.table)}{self._where(*ranged)}", values)
            while rows := found.fetchmany(FETCHED):
                arrays = [pa.array([v if isinstance(v, kind) else None for v in column], t) for column, kind, t in zip(zip(*rows, strict=True), kinds, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class PushedReader(SqliteReader):
    """The reader where the session lets filters be sent to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.schema.names:
                column = _named(f.attribute[0])
                if type(f) in COMPARED:
                    self._test(f"{column} {COMPARED[type(f)]} ?", f.value)
                elif isinstance(f, In):
                    self._test(f"{column} IN ({', '.join('?' * len(f.value))})", *f.value)
                elif isinstance(f, IsNotNull):  # IS NULL stays here: a value of another kind reads as null
                    self._test(f"{column} IS NOT NULL")
            yield f

    def _test(self, text: str, *values: object) -> None:
        if all(isinstance(v, (int, float, str)) for v in values):
            self.tests.append(text)
            self.values += values


def table(spark: SparkSession, path: str, name: str, required: tuple[str, ...] = (), partitions: int = 8) -> DataFrame:
    """A table of an SQLite file; it fails here if the file, the table or a required column isn't there.

    Filters are sent to the database if ``spark.sql.python.filterPushdown.enabled`` is true.
    """
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.dataSource.register(SqliteTable)
    return spark.read.format(SqliteTable.name()).options(path=path, table=name, required=",".join(required), partitions=str(partitions), pushed=pushed).load()
