"""Registry pairing every Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL when the result can be expressed in SQL."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return wrap


def _needed(sql: str, seen: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"\bv_\w+\b", sql)):
        if name in CTES and name not in seen:
            _needed(CTES[name], seen)
            seen.append(name)


def with_ctes(sql: str) -> str:
    """Put the shared views that ``sql`` mentions in front of it."""
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql
