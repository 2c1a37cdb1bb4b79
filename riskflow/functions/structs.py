"""Struct columns that hold derived values and thresholds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted


def struct_of(values: Mapping[str, Any]) -> Column:
    """Struct with one field per entry; plain values become literals."""
    fields = [
        (value if isinstance(value, Column) else F.lit(value)).alias(name)
        for name, value in values.items()
    ]
    return F.struct(*fields)


def set_fields(base: Column, values: Mapping[str, Column]) -> Column:
    """Add or overwrite fields of a struct and keep the others."""
    for name, value in values.items():
        base = base.withField("`" + name + "`", value)
    return base


def ensure_struct_columns(df: DataFrame, *names: str) -> DataFrame:
    """Make each column a struct that is never null, empty where the table has none.

    A null struct becomes a struct of nulls, since fields set on null would be lost.
    """
    return df.withColumns(
        {name: F.struct(*[field(name, f).alias(f) for f in field_names(df, name)]) for name in names}
    )


def field_names(df: DataFrame, column: str) -> list[str]:
    """Field names of a struct column, none if the table has no such struct."""
    if column not in df.columns:
        return []
    data_type = df.schema[column].dataType
    return data_type.fieldNames() if hasattr(data_type, "fieldNames") else []


def field(column: str, name: str) -> Column:
    """One field of a struct column."""
    return quoted(column).getField(name)
