"""Operators that run a user's Python function.

Use them only where no column expression does the job. All but ``row_function``
exchange Arrow batches with Python, so memory is bounded by a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType, VariantType

Frame = pd.DataFrame


def map_partitions(
    df: DataFrame, function: Callable[[Frame], Frame], schema: str | StructType
) -> DataFrame:
    """Apply a frame function to the batches of every partition."""

    def batches(frames: Iterator[Frame]) -> Iterator[Frame]:
        return map(function, frames)

    return df.mapInPandas(batches, schema)


def row_function(function: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A function of single values as a column function, with Arrow transfer."""
    return F.udf(function, returns, useArrow=True)


def series_function(function: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of whole series, one per argument column, as a column function."""

    @F.pandas_udf(returns)
    def batch(*series: pd.Series) -> pd.Series:
        return function(*series)

    return batch


def process_records(
    df: DataFrame,
    function: Callable[[dict], dict],
    schema: str | StructType,
    column: str = "data",
) -> DataFrame:
    """Call a function on every JSON record of a text column; it returns one row."""
    import json

    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def batches(frames: Iterator[Frame]) -> Iterator[Frame]:
        for frame in frames:
            rows = [function(json.loads(text)) for text in frame[column]]
            yield pd.DataFrame(rows, columns=names)

    return df.select(column).mapInPandas(batches, schema)


def each_key(keys: Sequence[str], function: Callable[[Frame], Frame]) -> Callable[[Frame], Frame]:
    """A function of one key's rows as one of the rows of many keys.

    It is called once a key, which costs more than a function that groups by itself.
    """
    keys = list(keys)

    def of_many(frame: Frame) -> Frame:
        parts = []
        for _, group in frame.groupby(keys, dropna=False, sort=False):
            result = function(group)
            own = group[keys].iloc[[0] * len(result)].set_axis(result.index)
            parts.append(result.assign(**{key: own[key] for key in keys}))
        return pd.concat(parts, ignore_index=True) if parts else frame

    return of_many


def combine_groups(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[Frame], Frame],
    merge: Callable[[Frame], Frame],
    schema: str | StructType,
    held_rows: int = 100_000,
) -> DataFrame:
    """Run a user's function over the rows of each key, without bringing them together.

    ``partial`` turns rows of many keys into one or few rows of ``schema`` for each of them;
    ``merge`` turns such rows into one or few for each key. Both must give the same however
    the rows are split up, at any size: a count is a count of rows and then a sum, a distinct
    count is no such function. Functions of one key's rows fit in by :func:`each_key`.

    Every task calls ``partial`` on ``held_rows`` rows at a time. Its results are all that is
    shuffled; they come to ``merge`` sorted by key, whole keys at a time, and where a key has
    more than ``held_rows`` of them, in turns with what they gave so far. Keys are Arrow
    values and never change their type: frames have them as Arrow-backed columns, in which
    null is no NaN, and a result with a key that the frame did not have fails. Whole numbers
    beside nulls come as nullable ones. Keys must be of plain types.
    """
    keys = list(keys)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if missing := [key for key in keys if key not in fields.names]:
        raise ValueError(f"the result lacks keys {missing}")
    if nested := [key for key in keys if isinstance(df.schema[key].dataType, (StructType, ArrayType, MapType, VariantType))]:
        raise ValueError(f"keys of nested types: {nested}")
    arrow_schema = df.sparkSession.createDataFrame([], fields).toArrow().schema
    # Zero and minus zero are one key.
    floating = {key: F.col(key) + F.lit(0).cast(df.schema[key].dataType) for key in keys
                if isinstance(df.schema[key].dataType, (DoubleType, FloatType))}
    rows = df.withColumns(floating) if floating else df

    def call(function: Callable[[Frame], Frame], table: pa.Table) -> pa.Table:
        result = pa.Table.from_pandas(
            function(_key_frame(table, keys))[arrow_schema.names], schema=arrow_schema, preserve_index=False
        )
        for key in keys:
            known = pc.is_in(result.column(key), pc.unique(table.column(key)).cast(result.schema.field(key).type))
            if not pc.all(known, min_count=0).as_py():
                raise ValueError(f"the function changed values of key {key!r}")
        return result

    def reduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches, held_rows):
            yield from call(partial, table).to_batches()

    def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for table in _tables(batches, held_rows):
            if rest is not None:
                table = pa.concat_tables([rest, table])
            # The last key may go on in the next table.
            start = _last_key(table, keys)
            if start:
                yield from call(merge, table.slice(0, start)).to_batches()
                rest = table.slice(start)
            else:
                rest = call(merge, table)
        if rest is not None:
            yield from call(merge, rest).to_batches()

    parts = rows.mapInArrow(reduce_task, fields).repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(merge_task, fields)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in turn as tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, len(batch), rows):
            part = batch.slice(start, rows)
            held.append(part)
            size += len(part)
            if size >= rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _key_frame(table: pa.Table, keys: Sequence[str]) -> Frame:
    columns = {}
    for name, column in zip(table.column_names, table.columns):
        whole = pa.types.is_integer(column.type) and column.null_count
        columns[name] = column.to_pandas(types_mapper=pd.ArrowDtype if name in keys or whole else None)
    return pd.DataFrame(columns)


def _last_key(table: pa.Table, keys: Sequence[str]) -> int:
    """Where the rows of the table's last key begin."""
    same = np.ones(len(table), dtype=bool)
    for key in keys:
        column = table.column(key)
        last = column[-1]
        if not last.is_valid:
            equal = pc.is_null(column)
        elif pa.types.is_floating(column.type) and last.as_py() != last.as_py():
            equal = pc.is_nan(column)
        else:
            equal = pc.equal(column, last)
        same &= np.asarray(pc.fill_null(equal, False))
    others = np.flatnonzero(~same)
    return int(others[-1]) + 1 if len(others) else 0


def cap_partitions(df: DataFrame, limit: int, shuffle: bool = False) -> DataFrame:
    """At most this many partitions; fewer stay as they are.

    For a small result on its way to a sink: the stage that gives it runs in as few tasks.
    Where that stage still reads much, ``shuffle`` lets it keep its tasks and deals the
    result to exactly ``limit`` partitions.
    """
    return df.repartition(limit) if shuffle else df.coalesce(limit)
