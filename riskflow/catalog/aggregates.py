"""Aggregates and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nesting
from ..operators.aggregates import (
    Aggregate,
    count_rows,
    distinct_count,
    get_aggregator,
    group_aggregate,
    group_by_config,
    group_median,
)
from ..plans.static_thresholds import nested_thresholds, threshold_rows, typed_thresholds
from .registry import query
from .shared import LAST_OF_DAY, THRESHOLD_TABLES, daily_events, exact_mean, money, threshold_tables


@query(
    "g1_group_by",
    """
    select l_returnflag, l_linestatus, count(*) as lines,
           cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total,
           min(l_shipdate) as first_ship, count(distinct l_suppkey) as suppliers
    from lineitem group by 1, 2
    """,
)
def group_by(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(money("l_extendedprice")).cast("double").alias("total"),
        F.min("l_shipdate").alias("first_ship"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query(
    "g2_sum",
    "select l_suppkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as total "
    "from lineitem group by 1",
)
def total(t):
    rows = t.lineitem.select("l_suppkey", money("l_quantity").alias("quantity"))
    summed = group_aggregate(rows, ["l_suppkey"], [Aggregate("quantity", "sum", "total")])
    return summed.withColumn("total", F.col("total").cast("double"))


@query(
    "g3_count",
    "select l_partkey, count(nullif(l_quantity, 10)) as n from lineitem group by 1",
)
def count(t):
    rows = t.lineitem.select("l_partkey", F.nullif("l_quantity", F.lit(10.0)).alias("q"))
    return group_aggregate(rows, ["l_partkey"], [Aggregate("q", "count", "n")])


@query(
    "g4_mean",
    "select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) "
    "/ count(o_totalprice) as average from orders group by 1",
)
def mean(t):
    return t.orders.groupBy("o_custkey").agg(exact_mean("o_totalprice").alias("average"))


@query(
    "g5_distinct_count",
    "select l_returnflag, count(distinct l_suppkey) as suppliers, "
    "count(distinct nullif(l_partkey, 7)) as parts from lineitem group by 1",
)
def distinct(t):
    part = F.nullif("l_partkey", F.lit(7))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct(part).alias("parts")
    )


@query(
    "g6_distinct_two_stages",
    "select l_returnflag, count(distinct l_partkey) as parts from lineitem group by 1",
)
def distinct_two_stages(t):
    return distinct_count(t.lineitem, ["l_returnflag"], "l_partkey", "parts")


@query("g7_group_size", "select event_type, count(*) as size from events group by 1")
def group_size(t):
    return count_rows(t.events, ["event_type"])


@query(
    "g8_std",
    "select o_custkey, round(stddev_samp(o_totalprice), 2) as std_o_totalprice from orders group by 1",
)
def std(t):
    grouped = t.orders.groupBy("o_custkey").agg(get_aggregator("o_totalprice", "std"))
    return grouped.withColumn("std_o_totalprice", F.round("std_o_totalprice", 2))


@query(
    "g9_var",
    "select o_custkey, round(var_samp(o_totalprice), 0) as spread from orders group by 1",
)
def var(t):
    grouped = t.orders.groupBy("o_custkey").agg(get_aggregator("o_totalprice", "VAR", "spread"))
    return grouped.withColumn("spread", F.round("spread", 0))


@query(
    "g10_min_max",
    "select o_custkey, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1",
)
def min_max(t):
    wanted = [Aggregate("o_totalprice", "min", "low"), Aggregate("o_totalprice", "max", "high")]
    return group_aggregate(t.orders, ["o_custkey"], wanted)


@query(
    "g11_median",
    "select o_custkey, median(o_totalprice) as middle, count(*) as n from orders group by 1",
)
def median(t):
    wanted = [Aggregate("o_totalprice", "median", "middle"), Aggregate("o_orderkey", "count", "n")]
    return group_aggregate(t.orders, ["o_custkey"], wanted)


@query(
    "g11_median_large_groups",
    "select l_returnflag, median(l_extendedprice) as middle from lineitem group by 1",
)
def median_large_groups(t):
    return group_median(t.lineitem, ["l_returnflag"], "l_extendedprice", "middle")


@query(
    "g12_first_last",
    """
    select o_custkey, first(o_totalprice order by o_orderdate, o_orderkey) as first,
           last(o_totalprice order by o_orderdate, o_orderkey) as last
    from orders group by 1
    """,
)
def first_last(t):
    order = ("o_orderdate", "o_orderkey")
    wanted = [
        Aggregate("o_totalprice", "first", "first", order),
        Aggregate("o_totalprice", "last", "last", order),
    ]
    return group_aggregate(t.orders, ["o_custkey"], wanted)


@query(
    "g13_aggregate_by_name",
    "select o_orderstatus, max(o_totalprice) as max_o_totalprice, count(o_custkey) as count_o_custkey "
    "from orders group by 1",
)
def aggregate_by_name(t):
    wanted = [get_aggregator("o_totalprice", "max"), get_aggregator("o_custkey", "count")]
    return t.orders.groupBy("o_orderstatus").agg(*wanted)


@query(
    "g14_config_group_by",
    "select o_custkey, min(o_totalprice) as o_totalprice_min, max(o_orderkey) as o_orderkey_max "
    "from orders group by 1",
)
def config_group_by(t):
    return group_by_config(
        t.orders, "o_custkey", "o_totalprice", ["o_totalprice", "o_orderkey"], "min, max"
    )


@query("g14_config_one_function", "select o_custkey, max(o_totalprice) as max from orders group by 1")
def config_one_function(t):
    return group_by_config(t.orders, ["o_custkey"], "o_totalprice", functions=["max"])


@query(
    "g15_functions_of_column",
    """
    select l_suppkey, min(l_extendedprice) as l_extendedprice_min,
           max(l_extendedprice) as l_extendedprice_max, count(l_extendedprice) as l_extendedprice_count,
           median(l_extendedprice) as l_extendedprice_median
    from lineitem group by 1
    """,
)
def functions_of_column(t):
    return group_by_config(
        t.lineitem, "l_suppkey", "l_extendedprice", functions="min, max, count, median"
    )


@query(
    "g16_collect_rows",
    """
    select user_id, cast(ts as date) as chunk, event_type, value, count(*) as copies
    from events group by 1, 2, 3, 4
    """,
)
def collect_rows(t):
    rows = nesting.collect_rows(
        t.events, ["user_id"], ["event_type", "value"], F.col("ts").cast("date")
    )
    return nesting.unnest_rows(rows, ["user_id", "chunk"], ["event_type", "value"])


@query(
    "g16_collect_large_groups",
    """
    select event_type, user_id % 64 as chunk, user_id, value, count(*) as copies
    from events group by 1, 2, 3, 4
    """,
)
def collect_large_groups(t):
    rows = nesting.collect_rows(
        t.events, ["event_type"], ["user_id", "value"], F.col("user_id") % 64
    )
    return nesting.unnest_rows(rows, ["event_type", "chunk"], ["user_id", "value"])


@query(
    "g16_collect_ranked",
    """
    with entries as (
      select event_type, user_id, value, count(*) as copies from events group by 1, 2, 3),
    ranked as (
      select *, row_number() over (partition by event_type order by user_id, value) - 1 as place from entries)
    select event_type, place // 500 as part, place % 500 as place, user_id, value, copies from ranked
    """,
)
def collect_ranked(t):
    """Lists of a few keys that own all rows."""
    lists = nesting.collect_ranked(t.events, ["event_type"], ["user_id", "value"], size=500)
    rows = lists.select("event_type", "part", F.posexplode("rows").alias("place", "row"))
    return rows.select("event_type", "part", F.col("place").cast("long").alias("place"), "row.*")


@query("g17_map_by_date", LAST_OF_DAY)
def map_by_date(t):
    maps = nesting.features_by_date(
        daily_events(t), "user_id", "day", ["event_type", "value"], ["ts", "event_id"]
    )
    return maps.select("user_id", F.explode("by_date").alias("day", "f")).select(
        "user_id", F.col("day").cast("date").alias("day"), "f.event_type", "f.value"
    )


@query(
    "g18_nested_thresholds",
    f"""
    with {THRESHOLD_TABLES},
    latest as (
      select TSHLD_SET_NAME as set_name, TSHLD_TYPE as type, TSHLD_NAME as name,
             last(THSLD_VALUE order by TSHLD_ID, TSHLD_SET_ID) as v,
             last(VALUE_TYPE order by TSHLD_ID, TSHLD_SET_ID) as vt
      from joined group by 1, 2, 3)
    select set_name, type, name,
           case when vt = 'integer' and v <> 'n/a' or vt = 'float' then v
                when vt = 'Boolean' then lower(v)
                else '"' || v || '"' end as json
    from latest
    """,
)
def threshold_maps(t):
    nested = nested_thresholds(typed_thresholds(threshold_rows(*threshold_tables(t))))
    types = nested.select(
        F.col("TSHLD_SET_NAME").alias("set_name"), F.explode("thresholds").alias("type", "names")
    )
    names = types.select("set_name", "type", F.explode("names").alias("name", "value"))
    return names.select("set_name", "type", "name", F.to_json("value").alias("json"))
