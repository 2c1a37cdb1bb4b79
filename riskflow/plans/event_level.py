"""Event table joined from the datasets that a config names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..config import Dataset
from ..operators.columns import select_qualified, split_qualified
from ..operators.joins import join_chain


def named_datasets(
    columns: Sequence[str], datasets: Mapping[str, Dataset]
) -> dict[str, Dataset]:
    """The datasets of ``dataset:column`` names, in order of first mention."""
    names = dict.fromkeys(split_qualified(c)[0] for c in columns)
    missing = [name for name in names if name not in datasets]
    if missing:
        raise ValueError(f"unknown datasets: {missing}")
    return {name: datasets[name] for name in names}


def event_level(columns: Sequence[str] | str, datasets: Mapping[str, Dataset]) -> DataFrame:
    """Join the named datasets in a chain and select the retained columns.

    The selection comes right after the joins, so the scans read just these columns
    and the keys.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    return select_qualified(join_chain(named_datasets(columns, datasets)), columns)
