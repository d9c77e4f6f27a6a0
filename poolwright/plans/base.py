"""The registry's two tables and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, without a negative zero, as the oracles have them."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        x = F.col(f"`{name}`")
        out.append((F.round(x, digits) + F.lit(0.0)).alias(name) if kind == "double" else x)
    return df.select(*out)


def rounded_sql(columns: dict[str, str], digits: int = 6) -> str:
    """SELECT list: the expressions rounded, by name."""
    return ", ".join(f"round({expr}, {digits}) + 0.0 AS {name}" for name, expr in columns.items())
