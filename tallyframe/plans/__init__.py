"""Registered plans: each module maps a query name to ``(callable, oracle SQL)``.

A callable takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables; the SQL is the DuckDB statement that must return the same rows
(``None`` when no SQL form exists).
"""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "bench", "validate", "inventory", "catalog", "metadata", "vectors", "monitor", "files", "logs")


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(f"tallyframe.plans.{m}")
        for name, entry in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = entry
    return out
