"""Parquet and CSV tables, and JSON text of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import quoted


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# As most tools write CSV: quotes inside a text are doubled and white space is kept.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# What the parser hands on for a value that is not there, so that "" stays a text.
_ABSENT = "\x00"


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header, read with a given schema; values must fit it.

    Columns are found by their name in the header, whatever their order; a missing one
    raises, others are left out, and files whose header differs from the first one's
    fail. An empty value is null, a quoted empty one is an empty text. A schema is asked
    for because inferring one reads all of the data first.

    ``line_breaks`` allows line breaks inside quoted values. Each file is then one task,
    so large data should come in many files.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {field.name: field.dataType for field in wanted}
    reader = spark.read.options(**_CSV, mode="FAILFAST", multiLine=line_breaks)
    reader = reader.option("nullValue", _ABSENT).option("emptyValue", "")
    found = reader.csv(path).columns
    missing = [name for name in types if name not in found]
    if missing:
        raise ValueError(f"no columns {missing} in the header of {path}")
    fields = [StructField(name, types.get(name, StringType())) for name in found]
    rows = reader.option("enforceSchema", False).schema(StructType(fields)).csv(path)
    return rows.select(*[quoted(name) for name in types])


def text_schema(columns: Sequence[str]) -> StructType:
    """Schema of text columns, as for a catalogue file."""
    return StructType([StructField(name, StringType()) for name in columns])


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that :func:`read_csv` and other tools read: null is empty, an empty text is ``""``."""
    df.write.mode(mode).options(**_CSV).csv(path)


def write_json_text(df: DataFrame, path: str, column: str = "json", mode: str = "overwrite") -> None:
    """Write a column of JSON texts, one per line."""
    df.select(column).write.mode(mode).text(path)
