"""Named queries over the test tables, and the same in SQL."""

from __future__ import annotations

import importlib

MODULES = ["duplicates", "signals", "arrange", "streams"]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in importlib.import_module(f"tempograph.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(f"tempograph.plans.{m}").SQL.items()}
