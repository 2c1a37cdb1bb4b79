"""Joins, first rows and row dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Dataset
from ..operators.aggregates import count_rows, distinct_count
from ..operators.joins import chain_join, join_groups, join_on_keys
from ..operators.ordering import head, newest
from ..plans.static_thresholds import threshold_rows
from .registry import query
from .shared import THRESHOLD_TABLES, threshold_tables


@query(
    "j1_inner_same_key",
    "select o_custkey as custkey, o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
)
def inner_same_key(t):
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    customers = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    return join_on_keys(orders, customers, ["custkey"])


@query(
    "j2_inner_key_lists",
    """
    select c_custkey, c_nationkey, n_name from customer
    join nation on c_nationkey = n_nationkey and c_custkey % 5 = n_regionkey
    """,
)
def inner_key_lists(t):
    customers = t.customer.select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("rest")
    )
    joined = join_on_keys(customers, t.nation, ["c_nationkey", "rest"], ["n_nationkey", "n_regionkey"])
    return joined.select("c_custkey", "c_nationkey", "n_name")


@query(
    "j3_left_key_lists",
    """
    select o_orderkey, o_custkey, c_acctbal from orders
    left join (select * from customer where c_acctbal > 5000) on o_custkey = c_custkey
    """,
)
def left_key_lists(t):
    customers = t.customer.filter(F.col("c_acctbal") > 5000).select("c_custkey", "c_acctbal")
    orders = t.orders.select("o_orderkey", "o_custkey")
    return join_on_keys(orders, customers, ["o_custkey"], ["c_custkey"], "left")


@query(
    "j4_chain_join",
    """
    select o_orderkey as orderkey, o_totalprice as amount, l_extendedprice as amount_lines,
           l_linenumber as line
    from orders join lineitem on o_orderkey = l_orderkey
    """,
)
def chain(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("amount")
    )
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linenumber").alias("line"),
    )
    return chain_join({"orders": Dataset(orders, ("orderkey",)), "lines": Dataset(lines, ("orderkey",))})


@query("j5_compound_join", f"with {THRESHOLD_TABLES} select * from joined")
def compound_join(t):
    return threshold_rows(*threshold_tables(t))


@query(
    "j6_join_aggregates",
    """
    select o_orderstatus, o_orderpriority, count(*) as orders,
           count(distinct o_custkey) as customers
    from orders group by 1, 2
    """,
)
def join_aggregates(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    orders = count_rows(t.orders, keys, "orders")
    return join_groups(orders, distinct_count(t.orders, keys, "o_custkey", "customers"), keys)


@query(
    "k1_head",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5",
)
def first_rows(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return head(orders, 5, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("k3_newest", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 1")
def newest_row(t):
    return newest(t.events.select("event_id", "ts", "event_type"), "ts", "event_id")


@query("u1_dedup", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def dedup(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()
