"""Computing an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection is copied into every later filter and expression that reads it, which repeats
    regular expressions and can outgrow the size limit of generated code.  A one-element generator is
    a point the optimizer does not copy through; filters on other columns still pass it.  The names
    must be new.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """:func:`once` for expressions written in SQL."""
    fields = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return df.selectExpr("*", f"inline(array(struct({fields})))")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for rules that name their input several times."""
    return F.element_at(F.transform(F.array(value), body), 1)
