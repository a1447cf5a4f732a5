"""Register of the runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, ints: str = "", longs: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows.

    ``ints`` and ``longs`` name columns whose SQL type is wider than Spark's and is cast to match.
    """
    casts = [f"CAST({c} AS INTEGER) AS {c}" for c in ints.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({check})" if casts else check
        return fn
    return add
