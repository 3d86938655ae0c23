"""Whole questions, put together from the operators, and the register of them."""

from __future__ import annotations

from importlib import import_module

from . import registry

MODULES = ["q_sessions", "q_search", "q_text", "q_events", "q_relations", "q_library", "q_sources", "q_views", "q_filters", "q_decisions", "q_archives", "q_reading", "q_lineage", "q_manifest", "q_retrieval"]


def queries() -> dict[str, registry.Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return registry.ORACLES
