"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def hash_sql(seed: int, *keys: str) -> str:
    """functions.text.hash_order() in SQL."""
    joined = " || '|' || ".join([f"'{seed}'", *[f"({k})::varchar" for k in keys]])
    return f"('0x' || substr(md5({joined}), 1, 8))::bigint"
