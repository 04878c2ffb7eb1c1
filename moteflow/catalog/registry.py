"""Registered queries: a Spark callable per key and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def r6(c: Column | str, digits: int = 6) -> Column:
    """Computed doubles are compared after rounding: sums differ in the last bits by order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def R(expr: str, digits: int = 6) -> str:
    """The SQL side of ``r6``; adding zero turns -0.0 into 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"
