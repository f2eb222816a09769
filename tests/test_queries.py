"""Every registered query of the engine against the SQL that states it again, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog
from tidemark.sources.projections import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLE[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_without_oracle_is_deterministic(spark, name):
    a, b = (catalog.QUERIES[name](spark, SF) for _ in range(2))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
