"""Query registry: name -> function, and name -> SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import SQL_VIEWS, SQL_VIEW_NEEDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _with(views: tuple[str, ...]) -> str:
    """WITH clause holding the given adapter views and the ones they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in SQL_VIEW_NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    return ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in ordered)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False):
    """Register a query; ``sql`` may name the adapter views listed in ``uses`` and may itself start with ``, cte AS``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            views = _with(uses)
            word = "WITH RECURSIVE " if recursive else "WITH "
            ORACLE[name] = (word + views + "\n" + sql.strip()) if views else sql.strip()
        return fn

    return register
