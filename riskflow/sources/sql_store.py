"""Named SQL texts and queries over named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_queries(spark: SparkSession, folder: str) -> dict[str, str]:
    """SQL texts of a folder by file name without ``.sql``; a missing folder raises."""
    files = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.sql$", "")
    return {row["name"]: row["value"] for row in files.select(name.alias("name"), "value").collect()}


def run_named(
    spark: SparkSession, queries: Mapping[str, str], name: str, tables: Mapping[str, DataFrame]
) -> DataFrame:
    """Run a named query; ``{table}`` in its text stands for one of the tables."""
    if name not in queries:
        raise KeyError(f"no query named {name!r}")
    return spark.sql(queries[name], **tables)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] = (0, 0),
    partitions: int = 1,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table or subquery, read in parallel by ranges of a column."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=dict(properties or {}))
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=dict(properties or {}),
    )
