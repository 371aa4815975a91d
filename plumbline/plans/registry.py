"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import audit, corpus, corruption, exchange, framework, views

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (corpus, corruption, audit, framework, views, exchange)


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
