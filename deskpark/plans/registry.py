"""Registered queries: ``(spark, sf_dir) -> DataFrame`` and their oracle SQL.

Each query binds the operator to the fixture views of the generated test
data and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskpark.plans import oracle_sql as OS
from deskpark.sources.fixtures import TestData

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[TestData], DataFrame]) -> Callable[[TestData], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(TestData(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        return fn
    return deco


def queries() -> dict[str, Query]:
    # Import for the side effect of registration.
    from deskpark.plans import bindings  # noqa: F401
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    have = queries()
    return {k: v for k, v in OS.ORACLE.items() if k in have}
