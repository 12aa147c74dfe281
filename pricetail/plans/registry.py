"""Collects the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Added before rounding.  Means of cent prices often end exactly on a rounding
# tie; the shift moves them off it, so that summation order cannot decide.
NUDGE = 3.7e-10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL when it has one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column | str) -> Column:
    """Rounded to six digits, never negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)


def sql_r6(expression: str) -> str:
    return f"(round(({expression})::DOUBLE + {NUDGE!r}, 6) + 0.0)"


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})
