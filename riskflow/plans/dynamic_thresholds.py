"""Dynamic thresholds: statistics of datasets joined onto events by key."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Calculation, Dataset, EventTable
from ..functions.casts import cast_value
from ..functions.columns import quoted
from ..functions.expression_types import kinds_of, types_of
from ..functions.expressions import Resolver, column_resolver, config_column
from ..functions.structs import ensure_struct_columns, field, field_names, set_fields
from ..operators.aggregates import Aggregate, group_aggregate
from ..operators.filters import rules_condition
from ..operators.joins import join_on_keys, not_null

Step = tuple[int, Calculation]


def dynamic_threshold(
    events: Mapping[str, EventTable],
    datasets: Mapping[str, Dataset],
    calculations: Sequence[Calculation],
) -> dict[str, EventTable]:
    """Add ``derived_values`` and ``dynamic_thresholds`` to every event table.

    Calculations apply in order; a later field of the same name overwrites the
    earlier one. A calculation without group function takes its dataset's column as
    it is and keeps one event row per matching dataset row, whose values all such
    calculations over that dataset take. A second such dataset gives its last row by
    key, or must be unique by key if it has no order.
    """
    steps = []
    for i, calculation in enumerate(calculations):
        if calculation.dataset_id in datasets:
            steps.append((i, calculation))
        else:
            warnings.warn(f"unknown dataset {calculation.dataset_id!r} skipped", stacklevel=2)
    by_key: dict[int, list[DataFrame]] = {}
    result = {}
    for name, table in events.items():
        width = len(table.primary_key)
        if width not in by_key:
            by_key[width] = _values_by_key(datasets, steps, width)
        df = _with_thresholds(table, by_key[width], datasets, steps)
        result[name] = EventTable(df, table.primary_key)
    return result


def _with_thresholds(
    table: EventTable,
    tables: Sequence[DataFrame],
    datasets: Mapping[str, Dataset],
    steps: Sequence[Step],
) -> DataFrame:
    events = df = table.df
    for values in tables:
        df = join_on_keys(df, values, table.primary_key, _key_names(len(table.primary_key)), "left")
    computed = set(df.columns)
    derived = {name: field("derived_values", name) for name in field_names(events, "derived_values")}
    dynamic = {
        name: field("dynamic_thresholds", name)
        for name in field_names(events, "dynamic_thresholds")
    }
    new_derived: dict[str, Column] = {}
    new_dynamic: dict[str, Column] = {}
    for i, calculation in steps:
        for name in calculation.derived.functions or (calculation.derived.column,):
            # An unknown function has been warned of and has no column.
            if _derived_name(i, name) in computed:
                derived[name] = new_derived[name] = F.col(_derived_name(i, name))
        resolve = _resolver(
            i, calculation, events.columns, datasets[calculation.dataset_id].df.columns,
            dict(derived), dict(dynamic),
        )
        values = {}
        types = types_of(df, resolve)
        for j, value in enumerate(calculation.values):
            kinds_of(value.expression, types)
            column = cast_value(config_column(value.expression, resolve), value.type)
            values[f"__value_{i}_{j}"] = column
            dynamic[value.name] = new_dynamic[value.name] = F.col(f"__value_{i}_{j}")
        if values:
            df = df.withColumns(values)
    df = ensure_struct_columns(df, "derived_values", "dynamic_thresholds")
    keep = [quoted(c) for c in events.columns if c not in ("derived_values", "dynamic_thresholds")]
    return df.select(
        *keep,
        set_fields(F.col("derived_values"), new_derived).alias("derived_values"),
        set_fields(F.col("dynamic_thresholds"), new_dynamic).alias("dynamic_thresholds"),
    )


def _values_by_key(
    datasets: Mapping[str, Dataset], steps: Sequence[Step], width: int
) -> list[DataFrame]:
    """What all calculations give, by key: tables for left joins onto the events.

    Grouped calculations over one dataset and keys are one aggregation, and all their
    results one table with a row per key. Calculations without group function over one
    dataset and keys are one table, of which the first may repeat keys.
    """
    names = _key_names(width)
    groups: dict[tuple[bool, str, tuple[str, ...]], list[Step]] = {}
    for step in steps:
        grouped = bool(step[1].derived.functions)
        groups.setdefault((grouped, step[1].dataset_id, step[1].keys), []).append(step)
    results, rows = [], []
    for (grouped, dataset_id, keys), members in groups.items():
        if grouped:
            results.append(_grouped(datasets[dataset_id], keys, members, names))
        else:
            rows.append(_as_they_are(datasets[dataset_id], keys, members, names, first=not rows))
    if len(results) > 1:
        # A column is set in one of the rows of a key only.
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
        values = [c for c in stacked.columns if c not in names]
        results = [stacked.groupBy(*names).agg(*[F.any_value(c, True).alias(c) for c in values])]
    return results + rows


def _as_they_are(
    dataset: Dataset, keys: Sequence[str], steps: Sequence[Step], key_names: Sequence[str], first: bool
) -> DataFrame:
    """Keys and columns of calculations without group function, a row per dataset row.

    Events can take several rows of one such table only. Of the others a key has its last
    row by the dataset's order; without an order a key with several rows fails the query.
    """
    conditions = {i: rules_condition(c.filters, dataset.df.schema) for i, c in steps}
    rows = dataset.df.filter(not_null(keys))
    if all(c is not None for c in conditions.values()):
        rows = rows.filter(reduce(or_, conditions.values()))
    columns = {}
    for i, calculation in steps:
        value, condition = quoted(calculation.derived.column), conditions[i]
        name = _derived_name(i, calculation.derived.column)
        columns[name] = value if condition is None else F.when(condition, value)
    order = [quoted(c).alias(f"__order_{k}") for k, c in enumerate(dataset.order_by)]
    if not first:
        rows = rows.select(*_keys_as(keys, key_names), *order, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__row"))
        if order:
            place = F.struct(*[f"__order_{k}" for k in range(len(order))], "__row")
            row = F.max_by("__row", place)
        else:
            repeated = F.raise_error(F.lit("a second dataset without order repeats a key"))
            row = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.any_value("__row"))
        return rows.groupBy(*key_names).agg(row.alias("__row")).select(*key_names, "__row.*")
    return rows.select(*_keys_as(keys, key_names), *[c.alias(n) for n, c in columns.items()])


def _grouped(
    dataset: Dataset, keys: Sequence[str], steps: Sequence[Step], key_names: Sequence[str]
) -> DataFrame:
    """One row per key with the group functions of several calculations."""
    conditions = {i: rules_condition(c.filters, dataset.df.schema) for i, c in steps}
    rows = dataset.df.filter(not_null(keys))
    shared = len({c.filters for _, c in steps}) == 1
    if all(c is not None for c in conditions.values()):
        any_of = list(conditions.values())[:1] if shared else list(conditions.values())
        rows = rows.filter(reduce(or_, any_of))
    aggregates, counts, measured = [], [], {}
    for i, calculation in steps:
        name, condition = f"__measure_{i}", None if shared else conditions[i]
        value = quoted(calculation.derived.column)
        measured[name] = value if condition is None else F.when(condition, value)
        order = list(dataset.order_by)
        if condition is not None:
            # Rows that the calculation filters out have no place in its order.
            order = [f"__order_{i}_{k}" for k in range(len(order))]
            measured |= {
                alias: F.when(condition, quoted(c)) for alias, c in zip(order, dataset.order_by)
            }
        for function in dict.fromkeys(calculation.derived.functions):
            alias = _derived_name(i, function)
            aggregates.append(Aggregate(name, function, alias, tuple(order)))
            if function.lower() == "count" and condition is not None:
                # No row at all is unknown, not zero, as for a key without match.
                measured[f"__kept_{i}"] = F.when(condition, F.lit(1))
                kept = f"{alias}_kept"
                aggregates.append(Aggregate(f"__kept_{i}", "count", kept))
                counts.append((alias, kept))
    rows = rows.select(
        *_keys_as(keys, key_names),
        *[quoted(c) for c in dataset.order_by],
        *[column.alias(name) for name, column in measured.items()],
    )
    result = group_aggregate(rows, key_names, aggregates)
    for alias, kept in counts:
        result = result.withColumn(alias, F.when(F.col(kept) > 0, F.col(alias))).drop(kept)
    return result


def _resolver(
    i: int,
    calculation: Calculation,
    event_columns: Sequence[str],
    dataset_columns: Sequence[str],
    derived: Mapping[str, Column],
    dynamic: Mapping[str, Column],
) -> Resolver:
    own = calculation.derived.column if not calculation.derived.functions else None
    plain = column_resolver(dataset_columns)

    def resolve(prefix: str, name: str) -> Column:
        known = {"derived": derived, "dth": dynamic}.get(prefix)
        if known is not None:
            if name not in known:
                raise ValueError(f"no value {prefix}.{name} at this calculation")
            return known[name]
        if prefix == "ds" and name == own:
            return F.col(_derived_name(i, name))
        if prefix in ("ev", "ds") and name not in event_columns:
            raise ValueError(f"the event table has no column {name!r}")
        return plain(prefix, name)

    return resolve


def _key_names(width: int) -> list[str]:
    return [f"__key_{k}" for k in range(width)]


def _derived_name(i: int, name: str) -> str:
    return f"__derived_{i}_{name}"


def _keys_as(keys: Sequence[str], names: Sequence[str]) -> list[Column]:
    if len(keys) != len(names):
        raise ValueError(f"{len(keys)} calculation keys for {len(names)} event keys")
    return [quoted(key).alias(name) for key, name in zip(keys, names)]
