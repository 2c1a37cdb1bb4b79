"""Rule configuration as plain values, and the named tables a rule works on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


def _names(value: str | Sequence[str]) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class Dataset:
    """A table with its joining keys.

    ``order_by`` names the columns that give rows a defined order; ``first`` and
    ``last`` need it, since rows of a distributed table have no order of their own.
    """

    df: DataFrame
    keys: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", _names(self.keys))
        object.__setattr__(self, "order_by", _names(self.order_by))


@dataclass(frozen=True)
class EventTable:
    """An event table and the columns that calculations join on."""

    df: DataFrame
    primary_key: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "primary_key", _names(self.primary_key))


@dataclass(frozen=True)
class FilterRule:
    """One ``column operator value`` condition; the value may be config text."""

    column: str | None
    operator: str | None
    value: Any = None


@dataclass(frozen=True)
class DerivedValues:
    """The measured column and the group functions; none means "use it as is"."""

    column: str
    functions: tuple[str, ...] = ()


@dataclass(frozen=True)
class ThresholdValue:
    """A named threshold, its type name and the expression that yields it."""

    name: str
    type: str
    expression: str


@dataclass(frozen=True)
class Calculation:
    """One dynamic-threshold calculation over one dataset."""

    dataset_id: str
    keys: tuple[str, ...]
    derived: DerivedValues
    filters: tuple[FilterRule, ...] = ()
    values: tuple[ThresholdValue, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", _names(self.keys))
