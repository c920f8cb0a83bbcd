"""Registry of the runnable queries and of the SQL text each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, tuple[str, tuple[str, ...]]] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Name a reusable table expression of the check SQL."""
    _PARTS[name] = (tuple(needs), sql.strip())


def compose(body: str, needs: tuple[str, ...] = ()) -> str:
    """Put the named expressions a statement needs in front of it as one WITH clause."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _PARTS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query under its survey id; ``sql`` is left out where SQL cannot state the result."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = (sql, tuple(needs))
        return fn

    return wrap


def oracles() -> dict[str, str]:
    return {name: compose(sql, needs) for name, (sql, needs) in _CHECKS.items()}
