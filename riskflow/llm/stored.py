"""Intermediate tables in the shared working folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import working_folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: it cuts the lineage and survives a lost executor."""
    spark = frame.sparkSession
    path = working_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
