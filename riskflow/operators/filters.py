"""Filters from rule configs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..config import FilterRule
from ..functions import comparators as cmp
from ..functions.columns import quoted
from ..functions.expression_types import check_comparison, types_in
from ..functions.expressions import (
    column_resolver,
    config_column,
    has_path,
    literal_for,
    parse_sequence,
)

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": cmp.eq,
    "neq": cmp.ne,
    "gt": cmp.gt,
    "lt": cmp.lt,
    "gte": cmp.gte,
    "lte": cmp.lte,
}
OPERATORS = (*COMPARISONS, "between", "in", "like")


def rule_condition(rule: FilterRule, schema: T.StructType) -> Column | None:
    """Condition of one rule, or None where column, operator or value is absent.

    Unknown operators raise: a rule that silently drops a filter flags the wrong rows.
    """
    if rule.column is None or rule.operator is None or rule.value is None:
        return None
    if rule.column not in schema.fieldNames():
        raise ValueError(f"filter on unknown column {rule.column!r}")
    column, data_type = quoted(rule.column), schema[rule.column].dataType

    def operand(value: Any) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, str) and has_path(value):
            check_comparison(rule.column, value, types_in(schema))
            return config_column(value, column_resolver(schema.fieldNames()))
        return literal_for(value, data_type)

    name = rule.operator.strip().lower()
    if name in COMPARISONS:
        return COMPARISONS[name](column, operand(rule.value))
    if name == "between":
        bounds = parse_sequence(rule.value)
        if len(bounds) != 2:
            raise ValueError(f"between needs two values, got {rule.value!r}")
        return column.between(operand(bounds[0]), operand(bounds[1]))
    if name == "in":
        return column.isin([operand(v) for v in parse_sequence(rule.value) if v is not None])
    if name == "like":
        return cmp.contains(column, rule.value)
    raise ValueError(f"unknown filter operator {rule.operator!r}")


def rules_condition(rules: Iterable[FilterRule], schema: T.StructType) -> Column | None:
    """All rules joined with AND, or None if there is nothing to check."""
    conditions = [c for c in (rule_condition(r, schema) for r in rules) if c is not None]
    return reduce(and_, conditions) if conditions else None


def apply_filters(df: DataFrame, rules: Iterable[FilterRule]) -> DataFrame:
    """Keep the rows that meet every rule."""
    condition = rules_condition(rules, df.schema)
    return df if condition is None else df.filter(condition)
