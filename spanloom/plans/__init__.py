"""Registered queries: the given tables bound to traces and spans, and checked SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["sources", "rollups", "lookups", "analytics", "drift", "cost", "errors", "metering", "security", "text", "streams"]


def _registries():
    return [importlib.import_module(f".{name}", __name__).reg for name in FAMILIES]


def all_queries() -> dict:
    return {name: fn for reg in _registries() for name, fn in reg.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for reg in _registries() for name, sql in reg.sql.items()}
