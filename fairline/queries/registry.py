"""Registration of queries together with their SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairline.queries.sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*keys: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register one query under every operator id it answers."""

    def wrap(fn):
        for key in keys:
            if key in QUERIES:
                raise ValueError(f"duplicate query id {key}")
            QUERIES[key] = fn
            if sql is not None:
                ORACLES[key] = with_views(views, sql)
        return fn

    return wrap
