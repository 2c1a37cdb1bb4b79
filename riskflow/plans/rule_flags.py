"""Flags that compare event values with thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expression_types import check_kind, types_in
from ..functions.expressions import column_resolver, config_column


def with_flag(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a flag from an expression over ``ev``, ``th``, ``dth`` and ``derived``.

    The flag is null where a threshold it needs is unknown. An expression that mixes kinds
    of values, or gives no boolean, raises before anything runs.
    """
    check_kind(expression, types_in(df.schema), "boolean")
    return df.withColumn(name, config_column(expression, column_resolver(df.columns)))


def flagged(df: DataFrame, name: str) -> DataFrame:
    """The rows whose flag is true; unknown counts as not flagged."""
    return df.filter(F.coalesce(F.col(name), F.lit(False)))
