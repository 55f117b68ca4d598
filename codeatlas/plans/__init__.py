"""Queries over the driver's tables, built from the library's operators."""

from importlib import import_module

MODULES = ["graph_queries", "trace_queries", "corpus_queries", "dedupe_queries", "activity_queries", "config_queries", "code_queries", "index_queries", "lineage_queries"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"codeatlas.plans.{name}")
