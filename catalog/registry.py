"""Where queries and their oracles meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from finfacts.session import tuned

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows on the same tables."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = wraps(fn)(lambda spark, sf: fn(tuned(spark), sf))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
