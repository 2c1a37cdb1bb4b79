"""First rows, newest row, and sums over the rows before a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..session import written
from .joins import join_groups


def head(df: DataFrame, n: int = 5, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first ``n`` rows, of any order or of the one given.

    With an order, each task keeps its own top ``n`` and only these are merged.
    """
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def newest(df: DataFrame, *order_by: str) -> DataFrame:
    """The one row that is last by the given columns."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(1)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    sums: Mapping[str, str | Column],
    split_by: Sequence[str | Column] = (),
    block: str | Column | None = None,
) -> DataFrame:
    """Add, per name of ``sums``, the column's sum over the key's rows before the row.

    ``order_by`` must tell the rows of a key apart; nulls come first. No task sees all rows
    of a key: rows are cut into ranges by key and order, summed within each, and every range
    then gets the total of the key's ranges before it. The ranges are a written table, so
    both steps see the same ones. ``split_by`` may name shorter columns to cut by, which must
    not contradict the order. Where a ``block`` of the row is known that ascends with the
    order and holds a bounded number of a key's rows, it takes the place of the ranges and
    nothing is written.
    """
    names = {name: as_column(column) for name, column in sums.items()}
    if block is None:
        ranges = df.repartitionByRange(*keys, *(split_by or order_by))
        blocks = written(ranges.withColumn("__block", F.spark_partition_id()), "ranges")
    else:
        blocks = df.withColumn("__block", as_column(block))
    upto = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order_by).rowsBetween(*upto)
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(*upto)
    totals = blocks.groupBy(*keys, "__block").agg(*[F.sum(c).alias(f"__{n}") for n, c in names.items()])
    offsets = totals.select(
        *keys, "__block", F.row_number().over(Window.partitionBy(*keys).orderBy("__block")).alias("__nth"),
        *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in names],
    )
    # A key's first block needs none; of ranges only one key continues from the range before.
    offsets = offsets.filter(F.col("__nth") > 1).drop("__nth")
    zero = F.lit(0)
    local = blocks.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in names.items()})
    joined = join_groups(local, offsets, [*keys, "__block"], "left")
    added = {n: F.col(n) + F.coalesce(F.col(f"__{n}"), zero) for n in names}
    return joined.withColumns(added).drop("__block", *[f"__{n}" for n in names])
