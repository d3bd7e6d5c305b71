"""Named queries over the sample tables, each with an optional check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (tables) under `name`, with the SQL that must agree with it.

    `{view}` in the SQL stands for a sample view of that name.
    """
    def wrap(fn):
        from .views import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = expand(sql)
        return fn

    return wrap


def expand(sql: str) -> str:
    """Put the view definitions into a statement as named sub-queries."""
    out = sql
    for view, text in VIEW_SQL.items():
        out = out.replace("{" + view + "}", f"({text})")
    return out


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """A double rounded for comparison, under the given name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits).alias(name)


def as_long(c: Column | str, name: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name)
