"""Rows gathered into lists, maps and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from .ordering import running_sums


def collect_rows(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    chunk: str | Column,
) -> DataFrame:
    """Rows of each key and ``chunk`` as one sorted list of structs.

    A list is one value of one row and must fit in memory. The caller names what bounds
    it, such as the day of an event; the shape is the same at any size, and all lists of
    a key together hold every row. Equal rows are one entry with their number in
    ``copies``, so that a list stays small however often a row repeats.
    """
    chunked = df.withColumn("chunk", as_column(chunk))
    entries = chunked.groupBy(*keys, "chunk", *columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = F.array_sort(F.collect_list(F.struct(*columns, "copies")))
    return entries.groupBy(*keys, "chunk").agg(rows.alias("rows"))


def collect_ranked(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    size: int = 10_000,
    split_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Rows of each key in order, as lists of up to ``size`` entries, one row per list.

    For keys with more rows than any one task may hold, where no column bounds them: lists
    are cut by rank and called ``part`` 0, 1 and so on; all but a key's last are full. Equal
    rows are one entry with their number in ``copies``. Ranks come from ranges of the order
    (see :func:`running_sums`, also for ``split_by``), computed when this is called.
    """
    entries = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("copies"))
    ranked = running_sums(entries, keys, columns, {"__rank": F.lit(1)}, split_by)
    part = F.floor(F.col("__rank") / size).alias("part")
    rows = F.array_sort(F.collect_list(F.struct("__rank", *columns, "copies")))
    lists = ranked.groupBy(*keys, part).agg(rows.alias("rows"))
    return lists.withColumn("rows", F.transform("rows", lambda row: row.dropFields("__rank")))


def unnest_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows that were gathered into lists, each with its ``copies``."""
    entries = df.select(*keys, F.explode("rows").alias("__row"))
    return entries.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in (*columns, "copies")])


def latest_per_day(
    df: DataFrame,
    account: str,
    date: str,
    features: Sequence[str],
    order_by: Sequence[str | Column],
) -> DataFrame:
    """One feature struct per account and date; of several rows the last one wins.

    Repeats go in the pre-aggregation, so an account with very many rows reaches the
    shuffle as at most one row per date and task.
    """
    value = F.struct(*features)
    order = F.struct(
        *[as_column(c).alias(f"o{i}") for i, c in enumerate(order_by)], value.alias("v")
    )
    return df.groupBy(account, date).agg(F.max_by(value, order).alias("features"))


def features_by_date(
    df: DataFrame,
    account: str,
    date: str,
    features: Sequence[str],
    order_by: Sequence[str | Column],
) -> DataFrame:
    """Map from date text to feature struct per account.

    ``date`` must be a date column: the map then has at most one entry per calendar
    day, however many rows the account has.
    """
    if df.schema[date].dataType.typeName() != "date":
        raise ValueError(f"{date} must be a date column")
    daily = latest_per_day(df, account, date, features, order_by)
    entry = F.struct(F.col(date).cast("string").alias("key"), F.col("features").alias("value"))
    return daily.groupBy(account).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), _by_key)).alias("by_date")
    )


def nested_json(
    df: DataFrame,
    account: str,
    date: str,
    features: Sequence[str],
    order_by: Sequence[str | Column],
) -> DataFrame:
    """One JSON text per account: ``{account: {date: {feature: value}}}``."""
    nested = features_by_date(df, account, date, features, order_by)
    document = F.create_map(F.col(account).cast("string"), F.col("by_date"))
    # Null features are written as null, not left out.
    text = F.to_json(document, {"ignoreNullFields": "false"})
    return nested.select(account, text.alias("json"))


def _by_key(a: Column, b: Column) -> Column:
    left, right = a.getField("key"), b.getField("key")
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)
