"""A registry of sources by category: an ordered chain for each request, and a typed reason for each that had nothing.

A reader is a function of the request that returns rows. A source that isn't registered, breaks, lacks a
required column or has no row is passed over by name; only the last resort of a caller is to have none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


class NoData(NamedTuple):
    """Why a source gave nothing: UNKNOWN, BROKEN, INCOMPLETE or EMPTY."""

    source: str
    kind: str
    detail: str = ""


class NothingFound(LookupError):
    """No source of a chain had rows; ``reasons`` has one for each."""

    def __init__(self, category: str, reasons: list[NoData]) -> None:
        super().__init__(f"no data for {category}: " + "; ".join(f"{r.source} {r.kind}" for r in reasons))
        self.reasons = reasons


class Found(NamedTuple):
    rows: DataFrame
    source: str
    passed: list[NoData]


class Registry:
    def __init__(self) -> None:
        self._readers: dict[str, dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]]] = {}

    def register(self, category: str, source: str, reader: Callable[..., DataFrame], required: tuple[str, ...] = ()) -> None:
        if source in self._readers.setdefault(category, {}):
            raise ValueError(f"{category} has {source} already")
        self._readers[category][source] = (reader, required)

    def sources(self, category: str) -> list[str]:
        return list(self._readers.get(category, {}))

    def read(self, category: str, order: list[str] | None = None, **request: object) -> Found:
        """The rows of the first source of the order (by default that of registration) that has any.

        Of each source tried one row is looked for, no more; the rows are the source's own plan.
        """
        known, passed = self._readers.get(category, {}), []
        for source in order or known:
            if source not in known:
                passed.append(NoData(source, "UNKNOWN"))
                continue
            reader, required = known[source]
            try:
                rows = reader(**request)
                if missing := [c for c in required if c not in rows.columns]:
                    passed.append(NoData(source, "INCOMPLETE", ", ".join(missing)))
                elif rows.isEmpty():
                    passed.append(NoData(source, "EMPTY"))
                else:
                    return Found(rows, source, passed)
            except (PySparkException, Py4JJavaError, OSError, ValueError) as error:
                passed.append(NoData(source, "BROKEN", type(error).__name__))
        raise NothingFound(category, passed)
