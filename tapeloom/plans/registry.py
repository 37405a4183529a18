"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison.

    The small shift keeps exact halves away from the rounding border and turns
    negative zero into zero, so both engines agree on the last digit.
    """
    shift = 10.0 ** -(digits + 3)
    return df.select(
        *[
            (F.round(F.col(f.name) + shift, digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, alias: str, digits: int = 6) -> str:
    """The SQL side of :func:`rounded`."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0 AS {alias}"
