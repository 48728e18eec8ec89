"""Registry of the queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.workload.oracle_views import ORACLE_VIEWS
from loomlog.workload.views import TABLES, VIEWS, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its operator id, with reference SQL where SQL can say it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if oracle is not None:
            views = {**VIEWS, **ORACLE_VIEWS}
            ORACLES[name] = with_views(oracle, views, {t: t for t in TABLES}, recursive=True)
        return function

    return register
