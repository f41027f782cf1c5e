"""Registry that ties each query to its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str, name: str | None = None):
    """Register ``fn(*view DataFrames)``; ``views`` are passed in order and prefixed to ``sql``.

    A view written as ``name!`` is only for the SQL side.
    """
    def wrap(fn: Callable[..., DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(*[view(spark, sf, v) for v in views if not v.endswith("!")])
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(sql, *dict.fromkeys(v.rstrip("!") for v in views))
        return fn
    return wrap


def seconds(c: Column | str) -> Column:
    """Time as text to the second, the form both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: seconds(c) for c in cols})


def sec(expr: str) -> str:
    """The same text in the comparison SQL."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(tokens: list[str], close: bool = True) -> str:
    """SQL literal of the word pattern for an engine whose boundaries are ASCII already."""
    return literal(r"\b(" + "|".join(tokens) + ")" + (r"\b" if close else ""))


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"
