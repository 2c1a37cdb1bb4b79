"""Repeatable random-looking columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _mixed(value: Column) -> Column:
    """Hex text that looks random; md5, so that any engine gives the same."""
    return F.md5(value.cast("binary"))


def _pick(row_id: Column, seed: int, stream: int, size: int) -> Column:
    """A number below ``size`` from the row id; equal ids give equal numbers.

    The first 15 hex digits of a hash: no number of rows makes the choices repeat.
    """
    text = F.concat(row_id.cast("string"), F.lit(f":{seed}:{stream}"))
    digits = F.substring(_mixed(text), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size)).cast("int")


def with_choice(
    df: DataFrame, row_id: str, name: str, choices: Sequence[str], seed: int = 42
) -> DataFrame:
    """Add a column with one of the choices."""
    items = F.array(*map(F.lit, choices))
    return df.withColumn(name, F.get(items, _pick(F.col(row_id), seed, 1, len(choices))))


def with_sample(
    df: DataFrame, row_id: str, name: str, items: Sequence[str], most: int = 5, seed: int = 42
) -> DataFrame:
    """Add a list column with up to ``most`` different items."""
    row = F.col(row_id).cast("string")
    # Items in the order of their hashes with the row: any sample can come up.
    entries = [
        F.struct(_mixed(F.concat(row, F.lit(f":{seed}:2:{item}"))).alias("h"), F.lit(item).alias("item"))
        for item in items
    ]
    length = _pick(F.col(row_id), seed, 3, min(most, len(items)) + 1)
    drawn = F.slice(F.array_sort(F.array(*entries)), F.lit(1), length)
    return df.withColumn(name, F.transform(drawn, lambda entry: entry["item"]))


def synthetic_table(
    spark: SparkSession,
    rows: int,
    choices: Sequence[str],
    items: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """A table of ids with a choice and a sample column, the same in any partitioning."""
    ids = spark.range(rows)
    return with_sample(with_choice(ids, "id", "choice", choices, seed), "id", "tags", items, seed=seed)
