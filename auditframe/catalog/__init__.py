"""Every operator as a query over the given tables, with an equivalent ANSI query where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "classifiers", "texts", "redaction", "joins", "aggregates", "rankings", "reports")


def load() -> tuple[dict, dict]:
    """All queries and their ANSI twins."""
    for module in MODULES:
        import_module(f"auditframe.catalog.{module}")
    registry = import_module("auditframe.catalog.registry")
    return registry.QUERIES, registry.ORACLES
