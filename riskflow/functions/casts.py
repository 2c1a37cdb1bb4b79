"""Casts by type name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_column

# Type names accepted for columns, and the Spark type of each.
COLUMN_TYPES = {
    "string": "string",
    "int": "bigint",
    "integer": "bigint",
    "int64": "bigint",
    "int32": "int",
    "int16": "smallint",
    "int8": "tinyint",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float": "double",
    "double": "double",
    "float64": "double",
    "float32": "float",
    "decimal": "decimal(38,9)",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}

# Largest value of the unsigned types, which Spark holds in wider ones.
UNSIGNED_LIMITS = {"uint32": 2**32 - 1, "uint64": 2**64 - 1}

# Type names accepted for computed values; any other name is text.
VALUE_TYPES = {
    "str": "string",
    "float32": "float",
    "float64": "double",
    "int32": "int",
    "int64": "bigint",
    "bool": "boolean",
}


def cast_column(column: Column | str, type_name: str, strict: bool = True) -> Column | None:
    """Cast by column type name, or None for a name that is not known.

    Strict casts fail the query on a value that does not fit (under ANSI mode, the
    default); lenient ones give null. A negative value never fits an unsigned type, also
    where its whole part is zero.
    """
    name = type_name.lower()
    if name not in COLUMN_TYPES:
        return None
    source = as_column(column)
    target = COLUMN_TYPES[name]
    result = source.cast(target) if strict else source.try_cast(target)
    if name in UNSIGNED_LIMITS:
        limit = F.lit(str(UNSIGNED_LIMITS[name])).cast(target)
        # The cast drops fractions, and with them the sign of those below zero.
        negative = source.try_cast("double") < 0
        fits = result.between(F.lit(0).cast(target), limit) & ~negative
        misfit = F.when(fits | result.isNull(), result)
        result = (
            misfit.otherwise(F.raise_error(F.concat(F.lit(f"not a {name}: "), source.cast("string"))))
            if strict
            else misfit
        )
    return result


def cast_value(column: Column, type_name: str | None) -> Column:
    """Cast a computed value by type name; unknown names give text."""
    return column.cast(VALUE_TYPES.get((type_name or "").lower(), "string"))


def typed_value(value: Column | str, value_type: Column | str) -> dict[str, Column]:
    """A text value read by its declared type, one column per possible type.

    Exactly one of the columns is set unless the text is null. Text that does not
    fit its declared type stays text.
    """
    text = as_column(value).cast("string")
    kind = F.lower(as_column(value_type))
    # Java also reads "1d" and "1f" as numbers; these are not numbers here.
    suffixed = text.rlike(r"(?i)[0-9.][df]\s*$")
    as_long = F.when(kind == "integer", text.try_cast("bigint"))
    as_double = F.when((kind == "float") & ~suffixed, text.try_cast("double"))
    as_bool = F.when((kind == "boolean") & text.isNotNull(), F.lower(text) == "true")
    as_text = F.when(as_long.isNull() & as_double.isNull() & as_bool.isNull(), text)
    return {
        "value_long": as_long,
        "value_double": as_double,
        "value_bool": as_bool,
        "value_string": as_text,
    }


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))
