"""Registry of the text queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("syntax", "similar", "splitting", "near_duplicates", "handwritten", "packing", "leakage", "quality")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"quernel.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"quernel.llm.{m}").SQL.items()}
