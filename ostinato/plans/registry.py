"""Registry of named queries over the test tables, each with an optional checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ostinato.plans.views import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the body after the WITH clause of ``views``."""
    def wrap(fn):
        if name in QUERIES:
            raise KeyError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            needs_with = views or extra
            ORACLES[name] = (with_ctes(*views.split(), extra=extra) if needs_with else "") + sql
        return fn

    return wrap
