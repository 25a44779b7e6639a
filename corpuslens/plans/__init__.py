"""Jobs composed of operators, logical views of the driver tables, and the query registry."""

from __future__ import annotations

from importlib import import_module

QUERY_MODULES = ("corpus_queries", "detector_queries", "signal_queries", "ledger_queries", "file_queries")


def load_queries():
    """(queries, checking SQL) of every registered query."""
    from corpuslens.plans import registry
    for name in QUERY_MODULES:
        import_module(f"corpuslens.plans.{name}")
    return registry.QUERIES, registry.ORACLES
