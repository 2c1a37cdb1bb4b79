"""Joins on key lists and chains of joins over named tables.

No join here carries a hint: Spark broadcasts a side only when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, with skewed
partitions split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Dataset
from ..functions.columns import quoted


def join_on_keys(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join on key lists, position by position; the left keys are kept."""
    right_on = left_on if right_on is None else right_on
    _check_lengths(left_on, right_on)
    if list(left_on) == list(right_on):
        return left.join(right, list(left_on), how)
    taken = set(left.columns)
    clash = [c for c in right.columns if c in taken and c not in right_on]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    # Renamed first, so that equal names on the two sides stay apart.
    keys = {name: f"__right_{i}" for i, name in enumerate(right_on)}
    renamed = right.withColumnsRenamed(keys)
    condition = reduce(and_, (left[a] == renamed[keys[b]] for a, b in zip(left_on, right_on)))
    return left.join(renamed, condition, how).drop(*keys.values())


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on group keys kept from the left; the null group matches the null group."""
    names = {key: f"__group_{i}" for i, key in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    condition = reduce(and_, (left[key].eqNullSafe(renamed[names[key]]) for key in keys))
    return left.join(renamed, condition, how).drop(*names.values())


def join_chain(datasets: Mapping[str, Dataset]) -> DataFrame:
    """Inner joins along the datasets in order, each one aliased by its name.

    Every dataset joins the one before it, its keys equal to that one's keys by
    position. Columns stay addressable as ``dataset.column``.
    """
    if not datasets:
        raise ValueError("no datasets to join")
    joined, previous = None, ""
    for name, dataset in datasets.items():
        frame = dataset.df.alias(name)
        if joined is None:
            joined, previous = frame, name
            continue
        left_keys = datasets[previous].keys
        _check_lengths(left_keys, dataset.keys)
        condition = reduce(
            and_,
            (
                _qualified(previous, a) == _qualified(name, b)
                for a, b in zip(left_keys, dataset.keys)
            ),
        )
        joined, previous = joined.join(frame, condition, "inner"), name
    return joined


def chain_join(datasets: Mapping[str, Dataset]) -> DataFrame:
    """All columns of a join chain: right keys dropped, repeated names suffixed.

    A column whose name is taken is called ``column_dataset``.
    """
    selected: dict[str, Column] = {}
    for position, (name, dataset) in enumerate(datasets.items()):
        for column in dataset.df.columns:
            if position and column in dataset.keys:
                continue
            target = column if column not in selected else f"{column}_{name}"
            if target in selected:
                raise ValueError(f"column name taken: {target}")
            selected[target] = _qualified(name, column).alias(target)
    return join_chain(datasets).select(*selected.values())


def not_null(keys: Sequence[str]) -> Column:
    return reduce(and_, (quoted(key).isNotNull() for key in keys))


def _qualified(dataset: str, column: str) -> Column:
    return F.col(f"`{dataset}`.`{column}`")


def _check_lengths(left: Sequence[str], right: Sequence[str]) -> None:
    if not left or len(left) != len(right):
        raise ValueError(f"join keys do not pair up: {list(left)} and {list(right)}")
