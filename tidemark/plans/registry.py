"""Registering queries: DataFrame functions with an oracle, and statements both engines understand.

``statement`` bodies refer to the projections of ``tidemark.sources.projections`` by name; Spark gets
them as temporary views, the oracle as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare
from tidemark.sources.projections import PROJECTIONS, TABLES, duck_form, spark_form

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _needs(body: str) -> list[str]:
    """Projections that a body uses, those they build on first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in PROJECTIONS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(PROJECTIONS[name])
                out.append(name)

    visit(body)
    return out


def oracle_text(body: str) -> str:
    ctes = [f"{name} AS ({duck_form(PROJECTIONS[name])})" for name in _needs(body)]
    body = duck_form(body).strip()
    if not ctes:
        return body
    word = "WITH RECURSIVE" if re.match(r"(?i)with\s+recursive\s", body) else "WITH"
    return f"{word} {', '.join(ctes)} " + re.sub(r"(?i)^with\s+(recursive\s+)?", ", ", body, count=1)


def views(spark: SparkSession, sf_dir: str, body: str) -> None:
    """Temporary views for what a body names; their files are opened only when it runs."""
    prepare(spark)
    names = _needs(body)
    text = " ".join([body, *(PROJECTIONS[n] for n in names)])
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in names:
        spark.sql(spark_form(PROJECTIONS[n])).createOrReplaceTempView(n)


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views(spark, sf_dir, name)
    return spark.table(name)


def statement(name: str, body: str) -> None:
    """A query stated once in SQL that both engines run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, body)
        return spark.sql(spark_form(body))

    run.__name__, run.__doc__ = name, body
    QUERIES[name], ORACLE[name] = run, oracle_text(body)


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir), with the SQL that states its result again."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle_text(sql)
        return f

    return add
