"""Named queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.sources.raster import PX_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its name; sql follows the fixture raster's definitions and `ctes`."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{PX_SQL}{',' + ctes if ctes else ''} {sql}"
        return f

    return register
