"""All registered queries of the library proper and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir) -> DataFrame`` and, where SQL can say the same, its oracle."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def queries() -> dict[str, Callable]:
    from . import plans  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from . import plans  # noqa: F401

    return ORACLES
