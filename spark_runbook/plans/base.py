"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Registers f(spark, sf_dir, *views) as a query; views are names of views, given in order. sql may name the views too."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views.values()))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql)
        return f

    return wrap
