"""Registered queries over the test tables, with their SQL counterparts."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ["q_filters", "q_scalars", "q_sources", "q_joins", "q_tables", "q_aggregates", "q_windows", "q_scoring", "q_similarity", "q_selection", "q_streams"]


def load_queries():
    """(queries, sql) after importing every query module."""
    from .registry import ORACLE, QUERIES

    for name in MODULES:
        if importlib.util.find_spec(f"{__name__}.{name}"):
            importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLE
