"""Registered queries: a Spark callable and, where SQL can say it, an oracle query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlab.catalog.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BARE_SQL: dict[str, str] = {}  # oracle texts before the sample views are added


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            BARE_SQL[name] = sql
            ORACLES[name] = with_views(sql)
        return fn

    return register
