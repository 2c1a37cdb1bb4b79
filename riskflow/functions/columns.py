"""Helpers that turn names and values into columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(column: Column | str) -> Column:
    """A column as it is; a string names a column."""
    return column if isinstance(column, Column) else F.col(column)


def quoted(name: str) -> Column:
    """The top-level column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def composite_key(*columns: Column | str, separator: str = "_") -> Column:
    """Text key from several columns; null as soon as one part is null."""
    parts: list[Column] = []
    for column in columns:
        if parts:
            parts.append(F.lit(separator))
        parts.append(as_column(column).cast("string"))
    return F.concat(*parts)


def flag(condition: Column, yes: str = "Yes", no: str = "No") -> Column:
    """Two-valued text flag; a null condition counts as not met."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def decoded_base64(column: Column | str) -> Column:
    """Bytes of base64 text, null where the text is not valid base64."""
    return F.try_to_binary(as_column(column), F.lit("base64"))
