"""Where registered queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from castleflow.plans.adapter import Model, oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *more: str):
    """Register a function of a model as a query under its own name, with its SQL."""

    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Model(spark, folder))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *more)
        return f

    return register
