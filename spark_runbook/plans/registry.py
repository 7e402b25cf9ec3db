"""All queries of the library and their SQL."""

from __future__ import annotations

from . import queries_books, queries_events, queries_logs, queries_stats, queries_streams  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
