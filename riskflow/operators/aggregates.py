"""Named aggregates and group-by from configs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_column
from ..session import written
from .joins import join_groups

_BUILDERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "median": F.median,
}
# A sketch of this size holds as many values as they are; of more, its ranks are off by less
# than 0.13 % of them in 99 of 100 cases. The middle is looked for within MARGIN of all ranks
# on both sides, over ten standard deviations, in CELLS cells.
SKETCH_SIZE = 4096
MARGIN = 0.006
CELLS = 64
# A group whose middle is missed gets so many cells over its whole range.
WIDE_CELLS = 1024
# Groups that a broadcast may hold; one takes less than a kB, or 8 kB where its cells are wide.
BROADCAST_GROUPS = 1000


@dataclass(frozen=True)
class Aggregate:
    """One aggregate of one column; ``first`` and ``last`` need ``order_by``."""

    column: str | Column
    function: str
    alias: str
    order_by: tuple[str, ...] = ()


def get_aggregator(
    column: str | Column,
    function: str,
    alias: str | None = None,
    order_by: Sequence[str | Column] = (),
) -> Column | None:
    """Aggregate expression by function name, called ``function_column`` by default.

    An unknown function warns and gives None.
    """
    name = function.strip().lower()
    alias = alias or f"{function.strip()}_{column}"
    if name in ("first", "last"):
        if not order_by:
            raise ValueError(f"{name} of {column} needs columns to order by")
        value = as_column(column)
        order = F.struct(
            *[as_column(c).alias(f"o{i}") for i, c in enumerate(order_by)], value.alias("v")
        )
        pick = F.min_by if name == "first" else F.max_by
        return pick(value, order).alias(alias)
    if name not in _BUILDERS:
        warnings.warn(f"unknown aggregate function {function!r} skipped", stacklevel=2)
        return None
    return _BUILDERS[name](as_column(column)).alias(alias)


def group_aggregate(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]
) -> DataFrame:
    """Group by the keys and compute all aggregates, one row per key.

    All of it is one aggregation; medians of groups beyond a sketch's size read their rows a
    second time, all of them together.
    """
    medians = {a.alias: a.column for a in aggregates if a.function.strip().lower() == "median"}
    together = [a for a in aggregates if a.alias not in medians]
    columns = [get_aggregator(a.column, a.function, a.alias, a.order_by) for a in together]
    columns = [c for c in columns if c is not None]
    if medians:
        result = _with_medians(df, keys, medians, columns)
    else:
        result = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
    # Medians go back to where they were asked for.
    names = [a.alias for a in aggregates if a.alias in result.columns]
    return result.select(*keys, *dict.fromkeys(names))


def group_median(
    df: DataFrame, keys: Sequence[str], column: str | Column, alias: str
) -> DataFrame:
    """Exact interpolated median per key; groups without a value are absent."""
    return group_medians(df, keys, {alias: column}).filter(F.col(alias).isNotNull())


def group_medians(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str | Column]
) -> DataFrame:
    """Exact interpolated medians per key of several columns, by alias.

    One aggregation gives a sketch per column and key. Of groups of up to ``SKETCH_SIZE``
    values it has them all, and with them the median. Of larger ones it gives values around
    the middle; their rows are read once more, all columns together: rows below are counted,
    rows between by value and cell, and only the cell that holds the middle, a few of 10,000
    rows, is put in order. Should a sketch be so far off that it misses the middle, the group
    is done again in cells over its whole range. NaN is above every number; a column without
    a value has no median; columns that are not numbers raise.

    The sketches, and what is found of large groups, are computed when this is called.
    """
    return _with_medians(df, keys, columns, [])


def _with_medians(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str | Column], others: Sequence[Column]
) -> DataFrame:
    keys, values = list(keys), {}
    for i, (alias, column) in enumerate(columns.items()):
        data_type = df.select(as_column(column).alias("v")).schema["v"].dataType
        if not isinstance(data_type, T.NumericType):
            raise ValueError(f"no median of {data_type.simpleString()}")
        values[i] = as_column(column).cast("double")
    sketches = []
    for i, value in values.items():
        # Sketches leave out NaN; as infinity it keeps its place above all numbers.
        kept = F.nanvl(value, F.lit(float("inf")))
        sketches += [
            F.kll_sketch_agg_double(kept, F.lit(SKETCH_SIZE)).alias(f"__sketch_{i}"),
            F.count_if(~F.isnan(value)).alias(f"__numbers_{i}"),
        ]
    groups = df.groupBy(*keys).agg(*others, *sketches)
    inner = [f"__{x}_{i}" for i in values for x in ("sketch", "numbers")]
    plain = [c for c in groups.columns if c not in inner]
    about = [c for i in values for c in (_median_of_sketch(i).alias(f"__median_{i}"), _bracket(i).alias(f"__bracket_{i}"))]
    groups = written(groups.select(*plain, *about), "groups")
    medians = {alias: F.col(f"__median_{i}") for i, alias in enumerate(columns)}
    is_large = {i: F.col(f"__bracket_{i}").isNotNull() for i in values}
    large = groups.filter(reduce(or_, is_large.values()))
    n_large = large.count()
    if n_large:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__bracket_{i}").alias("b")) for i in values])
        pairs = F.explode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("p")
        wanted = large.select(*keys, pairs).select(*keys, F.col("p.i").alias("__i"), "p.b.*")
        found = _large_medians(df, keys, values, wanted, n_large)
        groups = join_groups(groups, found, keys, "left")
        for i, alias in enumerate(columns):
            medians[alias] = F.when(is_large[i], F.col(f"__found_{i}")).otherwise(medians[alias])
    return groups.select(*plain, *[c.alias(alias) for alias, c in medians.items()])


def _ranks(i: int) -> tuple[Column, Column, Column]:
    """How many values a group has, and their two middle ranks."""
    n = F.kll_sketch_get_n_double(f"__sketch_{i}")
    return n, F.floor((n + 1) / 2), F.floor(n / 2) + 1


def _median_of_sketch(i: int) -> Column:
    n, low, high = _ranks(i)
    # Of up to SKETCH_SIZE values these shares are those of the two middle ranks.
    shares = _constants([0.5, 0.5 + 0.5 / SKETCH_SIZE])
    values = F.kll_sketch_get_quantile_double(f"__sketch_{i}", shares)
    median = F.when(high <= F.col(f"__numbers_{i}"), _middle(values[0], values[1])).otherwise(F.lit(float("nan")))
    return F.when(n > 0, median)


def _bracket(i: int) -> Column:
    """Ranks and cuts around the middle, MARGIN of all ranks on both sides; null if not needed."""
    n, low, high = _ranks(i)
    shares = _constants([0.5 + (2 * j / CELLS - 1) * MARGIN for j in range(CELLS + 1)])
    cuts = F.kll_sketch_get_quantile_double(f"__sketch_{i}", shares)
    # With a NaN in the middle the median is known, however large the group.
    needed = (n > SKETCH_SIZE) & (high <= F.col(f"__numbers_{i}"))
    return F.when(needed, F.struct(low.alias("__low"), high.alias("__high"), cuts.alias("__cuts")))


def _constants(numbers: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(f'{number!r}D' for number in numbers)})")


def _middle(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.lit(0.5) * a + F.lit(0.5) * b)


def _large_medians(
    df: DataFrame, keys: list[str], values: Mapping[int, Column], wanted: DataFrame, groups: int
) -> DataFrame:
    """Medians of the groups that a sketch does not hold, from a second scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in values.items()]))
    rows = df.select(*keys, pairs.alias("p")).select(*keys, F.col("p.i").alias("__i"), F.col("p.v").alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    at = [*keys, "__i"]
    found = written(_in_cells(rows, at, wanted, groups * len(values), whole=False), "medians")
    missed = found.filter("__missed").select(*at)
    n_missed = missed.count()
    if n_missed:
        few = F.broadcast(missed) if n_missed <= BROADCAST_GROUPS else missed
        kept = F.kll_sketch_agg_double("__v", F.lit(SKETCH_SIZE))
        shares = _constants([j / WIDE_CELLS for j in range(WIDE_CELLS + 1)])
        cuts = join_groups(rows, few, at).groupBy(*at).agg(F.kll_sketch_get_quantile_double(kept, shares).alias("__cuts"))
        again = join_groups(wanted.drop("__cuts"), cuts, at)
        found = found.filter("not __missed").union(_in_cells(rows, at, again, n_missed, whole=True))
    median = _middle(F.col("__a"), F.col("__b"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, median)).alias(f"__found_{i}") for i in values])


def _in_cells(rows: DataFrame, at: list[str], wanted: DataFrame, groups: int, whole: bool) -> DataFrame:
    """The two middle values of every wanted group, or that its cuts miss them.

    Rows beyond the cuts are counted below them and left out above, or form the outermost
    cells where the cuts span the ``whole`` group.
    """
    value, cuts, at_value = F.col("__v"), F.col("__cuts"), F.col("__at")
    # Few groups are told to every task; the rows of more than that go to their groups.
    joined = join_groups(rows, F.broadcast(wanted) if groups <= BROADCAST_GROUPS else wanted, at)
    if not whole:
        joined = joined.filter(value <= F.element_at(cuts, -1))
    cell = F.when(value < cuts[0], 0).otherwise(F.size(F.filter(cuts, lambda cut: cut <= value)))
    kept = value if whole else F.when(F.col("__cell") > 0, value)
    counted = joined.withColumn("__cell", cell).groupBy(*at, "__low", "__high", "__cell", kept.alias("__at"))
    counted = counted.agg(F.count(F.lit(1)).alias("__rows"))
    cells = counted.groupBy(*at, "__low", "__high", "__cell").agg(F.sum("__rows").alias("__n"), F.max(at_value.isNull()).alias("__outside"))
    group = Window.partitionBy(*at)
    low, high, before = F.col("__low"), F.col("__high"), F.col("__before")
    upto = F.sum("__n").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"__before": upto - F.col("__n"), "__all": F.sum("__n").over(group)})
    holds = ((low > before) & (low <= before + F.col("__n"))) | ((high > before) & (high <= before + F.col("__n")))
    # A group whose middle lies beyond the cuts keeps its last cell, to be told of.
    short = F.col("__all") < high
    last = before + F.col("__n") == F.col("__all")
    middle = cells.filter(holds | (short & last)).select(*at, "__cell", "__before", (short | F.col("__outside")).alias("__short"))
    order = Window.partitionBy(*at, "__cell").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = join_groups(counted, middle, [*at, "__cell"])
    rank = F.col("__rank")
    return inside.withColumn("__rank", before + F.sum("__rows").over(order)).groupBy(*at).agg(
        F.min(F.when(rank >= low, at_value)).alias("__a"),
        F.min(F.when(rank >= high, at_value)).alias("__b"),
        F.max("__short").alias("__missed"),
    )


def group_by_config(
    df: DataFrame,
    group_key: str | Sequence[str],
    group_col: str,
    columns: Sequence[str] | None = None,
    functions: str | Sequence[str] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Group by config: functions as a list or as comma-separated text.

    One function over one column is called like the function. Otherwise functions
    and columns pair up by position, a lone column serving all functions, and the
    results are called ``column_function``.
    """
    keys = [group_key] if isinstance(group_key, str) else list(group_key)
    columns = [group_col] if columns is None else list(columns)
    if isinstance(functions, str):
        functions = functions.split(",")
    functions = [f.strip() for f in functions or [] if f and f.strip()]
    if not functions:
        raise ValueError("no aggregate function given")
    if len(columns) == 1:
        columns = columns * len(functions)
    if len(columns) != len(functions):
        raise ValueError(f"{len(functions)} functions for {len(columns)} columns")
    aggregates = [
        Aggregate(
            column, function, function if len(functions) == 1 else f"{column}_{function}",
            tuple(order_by),
        )
        for column, function in zip(columns, functions)
    ]
    return group_aggregate(df, keys, aggregates)


def distinct_count(
    df: DataFrame, keys: Sequence[str], column: str, alias: str
) -> DataFrame:
    """Distinct values per key in two stages: drop repeats, then count.

    The first shuffle goes by key and value, so a large group is spread out; the
    count is pre-aggregated. Null is not a value, and a group of nulls has none.
    """
    distinct = df.select(*keys, column).dropDuplicates()
    return distinct.groupBy(*keys).agg(F.count(column).alias(alias))


def count_rows(df: DataFrame, keys: Sequence[str], alias: str = "size") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
