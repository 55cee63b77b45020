"""Query bindings: every operator of the engine bound to the given tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("customer_queries", "learning_queries", "quality_queries", "header_queries",
            "alignment_queries", "scoring_queries", "model_queries", "state_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tidemark.plans.{name}")


def queries():
    from tidemark.plans.registry import QUERIES
    _load()
    return dict(QUERIES)


def oracle_sql():
    from tidemark.plans.registry import ORACLES
    _load()
    return dict(ORACLES)
