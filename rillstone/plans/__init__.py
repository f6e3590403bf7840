"""The query catalogue."""

from __future__ import annotations

from .registry import SQL, QUERIES, Query


def queries() -> dict[str, Query]:
    """All queries by name."""
    from . import graphs, lifecycles, placements, programs, scalars  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL of the same meaning, by name."""
    queries()
    return SQL
