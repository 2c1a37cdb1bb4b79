"""Rule configs from XML."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Calculation, DerivedValues, FilterRule, ThresholdValue
from .rules_schema import shipped_schema


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _list_of(child: str, item: T.DataType) -> T.StructType:
    # Declared as an array, so that a lone element is a list of one.
    return T.StructType([T.StructField(child, T.ArrayType(item))])


CALCULATION_SCHEMA = T.StructType(
    [
        T.StructField("DatasetId", T.StringType()),
        T.StructField("Keys", _list_of("Key", T.StringType())),
        T.StructField("Filters", _list_of("Filter", _texts("Column", "Operator", "Value"))),
        T.StructField("DerivedValues", _texts("Column", "GroupFunction")),
        T.StructField("Values", _list_of("Value", _texts("_VALUE", "_name", "_type"))),
    ]
)
RULE_SCHEMA = T.StructType(
    [
        T.StructField("DynamicThresholdCalculations", _list_of("Calculation", CALCULATION_SCHEMA)),
        T.StructField("RetainedColumns", _list_of("Column", T.StringType())),
    ]
)


# The most rules in a file; a file is read by one task.
RULES_A_FILE = 20_000


def write_calculations(rules: DataFrame, path: str) -> None:
    """Write one ``Calculation`` element per row, in files of at most ``RULES_A_FILE``.

    An XML file is read by one task, so what a task reads is bounded by the rules of a file
    and not by all of them.
    """
    writer = rules.write.option("rowTag", "Calculation").option("rootTag", "DynamicThresholdCalculations")
    writer.option("maxRecordsPerFile", RULES_A_FILE).xml(path)


def read_calculations(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """One row per ``Calculation`` element of the XML files at the path, in no set order.

    An element that cannot be read fails the query. So does one that the scan finds to break
    the schema of rules, unless ``validate`` is off: without dataset or key, with an unknown
    operator or type of value, or with elements that rules do not have. The error names the
    file and what is wrong.
    """
    reader = _reader(spark, "Calculation", validate)
    return reader.schema(CALCULATION_SCHEMA).xml(path)


def _reader(spark: SparkSession, tag: str, validate: bool) -> DataFrameReader:
    reader = spark.read.option("rowTag", tag).option("mode", "FAILFAST")
    return reader.option("rowValidationXSDPath", shipped_schema(spark)) if validate else reader


def parse_rule(text: Column) -> Column:
    """A text column of whole rules as structs."""
    return F.from_xml(text, RULE_SCHEMA)


def load_calculations(spark: SparkSession, path: str, validate: bool = True) -> list[Calculation]:
    """Calculations of rule files as config values, by path and then place in the file.

    Raises where a file is not well-formed XML, or a calculation or filter lacks what
    it cannot do without: a rule that lost its filter would hold for everything. Elements
    are checked as by :func:`read_calculations`.
    """
    files = spark.read.text(path, wholetext=True)
    # XPath reads a whole file or fails, and counts what has to be found.
    expected = files.select(F.expr("xpath_int(value, 'count(//Calculation)')").alias("n"))
    total = expected.agg(F.sum("n")).first()[0] or 0
    lists = (
        _reader(spark, "DynamicThresholdCalculations", validate)
        .schema(_list_of("Calculation", CALCULATION_SCHEMA))
        .xml(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
            F.posexplode("Calculation").alias("place", "element"),
        )
    )
    rows = lists.orderBy("path", "start", "row", "place").collect()
    if len(rows) != total:
        raise ValueError(f"{total} calculations at {path}, of which {len(rows)} can be read")
    return [calculation(row["element"].asDict(recursive=True)) for row in rows]


def calculations(config: Mapping[str, Any]) -> list[Calculation]:
    """Calculations of a nested mapping with a ``Calculation`` element or list of them."""
    return [calculation(element) for element in _listed(config.get("Calculation"))]


def calculation(element: Mapping[str, Any]) -> Calculation:
    """A config value from a ``Calculation`` element as nested mappings.

    Takes what Spark reads from XML and also the shape of common XML-to-dict readers:
    lone elements instead of lists, attributes as ``@name``, text as ``#text``.
    """
    derived = element.get("DerivedValues") or {}
    functions = (derived.get("GroupFunction") or "").split(",")
    return Calculation(
        dataset_id=_required(element, "DatasetId"),
        keys=tuple(_children(element, "Keys", "Key")),
        filters=tuple(filter_rule(f) for f in _children(element, "Filters", "Filter")),
        derived=DerivedValues(
            column=derived.get("Column") or "",
            functions=tuple(f.strip() for f in functions if f.strip()),
        ),
        values=tuple(
            ThresholdValue(
                value.get("_name", value.get("@name")),
                value.get("_type", value.get("@type")),
                value.get("_VALUE", value.get("#text")) or "",
            )
            for value in _children(element, "Values", "Value")
        ),
    )


def filter_rule(element: Mapping[str, Any]) -> FilterRule:
    """A filter from a mapping with ``Column``, ``Operator`` and ``Value``."""
    column, operator = _required(element, "Column"), _required(element, "Operator")
    return FilterRule(column, operator, element.get("Value"))


def _required(element: Mapping[str, Any], name: str) -> Any:
    value = element.get(name)
    if value is None or not str(value).strip():
        raise ValueError(f"no {name} in {dict(element)}")
    return value


def retained_columns(config: Mapping[str, Any]) -> list[str]:
    """The ``dataset:column`` names of an event-level config."""
    return list(_children(config, "RetainedColumns", "Column"))


def _children(element: Mapping[str, Any], parent: str, child: str) -> list[Any]:
    return _listed((element.get(parent) or {}).get(child))


def _listed(value: Any) -> list[Any]:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]
