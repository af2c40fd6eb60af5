"""Registered queries: a DataFrame over the bundled tables, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbcurate.plans.views import AS_OF, Catalog, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register ``fn(catalog)`` under its name, with the equivalent SQL if there is one."""

    def wrap(fn: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Catalog.of(spark, folder))

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = with_views(oracle)
        return fn

    return wrap


def as_of() -> Column:
    return F.expr(AS_OF)
