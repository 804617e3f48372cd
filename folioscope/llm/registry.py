"""The llm queries by name, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Module of each query, in the order of the operators.
MODULES = (
    "pieces",
    "token_counts",
    "language",
    "near_dup",
    "sharding",
    "line_dedup",
    "telephony",
    "quality",
    "addressable",
    "packing",
)


def _modules():
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    return {m.QUERY: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.QUERY: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None)}
