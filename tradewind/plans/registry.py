"""Where queries register themselves with the SQL that defines the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None):
    """Registers a function under its name; views are the common table expressions that its SQL stands on."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            start = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.strip().startswith(w)), "")
            head = (start or "WITH ") + ", ".join(views) + ("," if start else "") if views else start
            ORACLE_SQL[f.__name__] = f"{head} {sql.strip()[len(start):]}"
        return f

    return keep
