"""Name -> (query, SQL twin) for the analytics operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "analytics_kpi"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query and, where SQL can say the same, its twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# The modules register themselves.
from tesserix.plans import analytics, codeintel, content, ledger, ranking, relational, reports, textforms, upkeep  # noqa: E402, F401
