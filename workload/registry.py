"""Where queries and their SQL checks are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a query under its function name, with SQL that reads the named views."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = compose(sql, views, recursive)
        return function

    return register


def compose(sql: str, views: tuple[str, ...] = (), recursive: bool = False) -> str:
    """Put the views before the SQL, merging with a WITH clause of its own."""
    body = sql.strip()
    declared = with_views(*views)
    if not declared:
        return body
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("WITH "):
        return f"{keyword} {declared},\n{body[5:]}"
    return f"{keyword} {declared}\n{body}"
