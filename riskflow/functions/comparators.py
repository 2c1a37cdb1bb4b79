"""Comparators that give a boolean column.

The left side is a column or the name of one. On the right a ``Column`` is a
column and anything else, text included, is a literal. Null compares to null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def gt(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) > column2


def lt(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) < column2


def gte(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) >= column2


def lte(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) <= column2


def eq(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) == column2


def ne(column1: Column | str, column2: Any) -> Column:
    return as_column(column1) != column2


ge, le = gte, lte


def contains(column: Column | str, pattern: str) -> Column:
    """True where the regular expression is found anywhere in the text."""
    return as_column(column).rlike(pattern)


def not_contains(column: Column | str, pattern: str) -> Column:
    return ~contains(column, pattern)


def is_in(column: Column | str, values: Sequence[Any]) -> Column:
    """Membership in a list of values; a null in the list matches nothing."""
    return as_column(column).isin([v for v in values if v is not None])


def not_in(column: Column | str, values: Sequence[Any]) -> Column:
    return ~is_in(column, values)


def create_operator(
    op_func: Callable[[Any, Any], Any], *, returns: str = "boolean", python: bool = False
) -> Callable[[Column | str, Any], Column]:
    """Turn a two-argument function into a column comparator.

    By default the function receives columns, so ``lambda a, b: a > 2 * b`` stays a
    native expression. With ``python=True`` it is plain Python over two values and
    runs on Arrow batches.
    """
    if not python:
        return lambda column1, column2: op_func(as_column(column1), _right(column2))

    @F.pandas_udf(returns)
    def batch(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([op_func(a, b) for a, b in zip(left, right)], index=left.index)

    return lambda column1, column2: batch(as_column(column1), _right(column2))


def _right(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
