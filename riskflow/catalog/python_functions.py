"""Operators that run a user's Python function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..operators import python_functions as py
from ..operators import record_effects
from ..operators.aggregates import count_rows
from .registry import query

HIGH_VALUE = """
select l_orderkey, l_linenumber, l_extendedprice as amount,
       case when l_extendedprice > 50000 then 'Yes' else 'No' end as high from lineitem
"""


def _amounts(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount"))


@query("z1_map_partitions", HIGH_VALUE)
def map_partitions(t):
    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(high=frame["amount"].gt(50000).map({True: "Yes", False: "No"}))

    schema = "l_orderkey bigint, l_linenumber int, amount double, high string"
    return py.map_partitions(_amounts(t), mark, schema)


@query("z2_row_function", HIGH_VALUE)
def row_function(t):
    mark = py.row_function(lambda amount: "Yes" if amount > 50000 else "No", "string")
    return _amounts(t).withColumn("high", mark("amount"))


@query(
    "z3_columns_function",
    "select l_orderkey, l_linenumber, l_extendedprice - l_quantity * 100 as rest from lineitem",
)
def columns_function(t):
    rest = py.series_function(lambda price, quantity: price - quantity * 100, "double")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", rest("l_extendedprice", "l_quantity").alias("rest")
    )


@query(
    "z4_process_records",
    "select cast(json_extract_string(props, '$.k') as bigint) as k, "
    "cast(json_extract_string(props, '$.k') as bigint) % 2 = 0 as even from events",
)
def process_records(t):
    records = t.events.select(F.col("props").alias("data"))
    return py.process_records(
        records, lambda r: {"k": r["k"], "even": r["k"] % 2 == 0}, "k bigint, even boolean"
    )


@query(
    "z4_record_effects",
    "select cast(json_extract_string(props, '$.k') as bigint) as k from events "
    "where cast(json_extract_string(props, '$.k') as bigint) % 2 = 0",
)
def record_effects_of_run(t):
    """What a callback emits, each record's once."""

    def announce(record: dict, emit: Callable[[str], None]) -> None:
        if record["k"] % 2 == 0:
            emit(str(record["k"]))

    folder = t.new_folder("effects")
    record_effects.process_each(t.events, announce, folder, "all", column="props")
    return record_effects.effects(t.spark, folder, "all").select(F.col("value").cast("bigint").alias("k"))


@query(
    "z5_cap_partitions",
    "select l_returnflag, l_linestatus, count(*) as size from lineitem group by 1, 2",
)
def cap_partitions(t):
    return py.cap_partitions(count_rows(t.lineitem, ["l_returnflag", "l_linestatus"]), 32)


@query(
    "z6_combine_groups",
    "select user_id, count(*) as n, max(value) as top from events group by 1",
)
def combine_groups(t):
    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        groups = frame.groupby("user_id", dropna=False, as_index=False)
        return groups.agg(n=("value", "size"), top=("value", "max"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby("user_id", dropna=False, as_index=False).agg({"n": "sum", "top": "max"})

    rows = t.events.select("user_id", "value")
    schema = "user_id bigint, n bigint, top double"
    return py.combine_groups(rows, ["user_id"], partial, merge, schema)


@query(
    "z6_combine_large_groups",
    "select event_type, count(*) as n, max(value) as top from events group by 1",
)
def combine_large_groups(t):
    """Few keys, by functions of one key's rows."""

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(frame)], "top": [frame["value"].max()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [frame["n"].sum()], "top": [frame["top"].max()]})

    rows = t.events.select("event_type", "value")
    schema = "event_type string, n bigint, top double"
    keys = ["event_type"]
    return py.combine_groups(rows, keys, py.each_key(keys, partial), py.each_key(keys, merge), schema)
