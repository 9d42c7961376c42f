"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and SQL.
MODULES = ("histogram_shard", "tool_calls", "boosted_trees", "exact_dedup", "cover_tree", "mixing", "packing", "pu_toxicity", "rolling_windows", "token_groups", "filter_audit", "class_ngrams", "spelling")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"quirelake.llm.{name}"), what)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
