"""Every registered query of the engine's own operators, with the SQL that states it again."""

from __future__ import annotations

from tidemark.plans import audits, carried, corpus, datasets, evidence, experience, gates, intake, outcomes, pages, replays, reports, series  # noqa: F401  these register their queries
from tidemark.plans.registry import ORACLE, QUERIES

FLAGSHIP = "outcome_evaluation"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
