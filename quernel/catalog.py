"""Registry of the core queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "quernel.operators.changefeed",
    "quernel.operators.history",
    "quernel.operators.graph",
    "quernel.operators.resolution",
    "quernel.operators.search",
    "quernel.operators.fusion",
    "quernel.operators.clones",
    "quernel.operators.refine",
    "quernel.operators.index",
    "quernel.operators.impact",
    "quernel.operators.incremental",
    "quernel.operators.evidence",
    "quernel.operators.verdicts",
    "quernel.operators.papertrail",
    "quernel.operators.memory",
    "quernel.operators.notes",
    "quernel.operators.briefs",
    "quernel.operators.derived",
    "quernel.streaming.feeds",
)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).SQL.items()}
