"""Named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from naskah.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle (views in braces)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def spans_sql(source: str, keys: str, text: str, pattern: str, flags: str = "") -> str:
    """Oracle sub-select: matches of ``pattern`` with start and end offsets."""
    pat = ("(?i)" if "i" in flags else "") + pattern.replace("'", "''")
    return f"""
      SELECT {keys}, {text} AS src, m[i] AS txt,
             CAST(list_sum(list_transform(q[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s,
             CAST(list_sum(list_transform(q[1:i], lambda x: length(x)))
                  + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS e
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT *, regexp_extract_all({text}, '{pat}') AS m,
                         regexp_split_to_array({text}, '{pat}') AS q FROM {source}) y) z"""
