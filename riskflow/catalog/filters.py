"""Filters and comparators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FilterRule
from ..functions import comparators as cmp
from ..operators.filters import apply_filters
from ..plans.bank_report import active_accounts
from .registry import query


@query(
    "f1_conjunction",
    """
    select c_custkey as account_id, c_acctbal as balance, c_mktsegment as status from customer
    where c_acctbal > 5000 and c_mktsegment = 'BUILDING'
    """,
)
def conjunction(t):
    accounts = t.customer.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("status"),
    )
    return active_accounts(accounts, min_balance=5000, status="BUILDING")


@query("f2_gt", "select o_orderkey from orders where o_totalprice > 250000")
def gt(t):
    return t.orders.filter(cmp.gt("o_totalprice", 250000)).select("o_orderkey")


@query("f3_lt", "select l_orderkey, l_linenumber from lineitem where l_discount < l_tax")
def lt(t):
    return t.lineitem.filter(cmp.lt("l_discount", F.col("l_tax"))).select("l_orderkey", "l_linenumber")


@query("f4_gte", "select o_orderkey, o_custkey >= 700 as hit from orders")
def gte(t):
    return t.orders.select("o_orderkey", cmp.gte("o_custkey", 700).alias("hit"))


@query("f5_lte", "select p_partkey from part where p_size <= 25")
def lte(t):
    return t.part.filter(cmp.lte("p_size", 25)).select("p_partkey")


@query("f6_eq", "select o_orderkey, nullif(o_orderstatus, 'P') = 'F' as hit from orders")
def eq(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", cmp.eq(status, "F").alias("hit"))


@query("f7_ne", "select o_orderkey, nullif(o_orderstatus, 'P') <> 'F' as hit from orders")
def ne(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", cmp.ne(status, "F").alias("hit"))


@query(
    "f8_contains",
    "select p_partkey, p_name from part where regexp_matches(p_name, '^(small|large) .*i')",
)
def contains(t):
    return t.part.filter(cmp.contains("p_name", "^(small|large) .*i")).select("p_partkey", "p_name")


@query("f9_not_contains", "select doc_id from documents where not regexp_matches(text, '[0-9]{4}')")
def not_contains(t):
    return t.documents.filter(cmp.not_contains("text", "[0-9]{4}")).select("doc_id")


@query("f10_is_in", "select event_id from events where event_type in ('error', 'click')")
def is_in(t):
    return t.events.filter(cmp.is_in("event_type", ["error", "click", None])).select("event_id")


@query("f11_not_in", "select o_orderkey from orders where nullif(o_orderstatus, 'P') not in ('F')")
def not_in(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.filter(cmp.not_in(status, ["F"])).select("o_orderkey")


@query(
    "f12_filter_list",
    """
    select o_orderkey from orders
    where o_orderstatus = 'O' and o_totalprice >= 100000 and o_custkey > 0
    """,
)
def filter_list(t):
    rules = [
        FilterRule("o_orderstatus", "eq", "O"),
        FilterRule("o_totalprice", "GTE", "100000"),
        FilterRule("o_custkey", "gt", 0),
        FilterRule("o_orderpriority", "eq", None),
    ]
    return apply_filters(t.orders, rules).select("o_orderkey")


@query(
    "f12a_eq_neq",
    "select p_partkey from part where p_type = 'ECONOMY' and p_brand <> 'Brand#2'",
)
def eq_neq(t):
    rules = [FilterRule("p_type", "eq", "ECONOMY"), FilterRule("p_brand", "neq", "'Brand#2'")]
    return apply_filters(t.part, rules).select("p_partkey")


@query(
    "f12b_order_comparisons",
    """
    select l_orderkey, l_linenumber from lineitem
    where l_quantity > 10 and l_quantity < 40 and l_discount >= 0.02 and l_tax <= 0.06
    """,
)
def order_comparisons(t):
    rules = [
        FilterRule("l_quantity", "gt", "10"),
        FilterRule("l_quantity", "lt", "40"),
        FilterRule("l_discount", "gte", "0.02"),
        FilterRule("l_tax", "lte", "0.06"),
    ]
    return apply_filters(t.lineitem, rules).select("l_orderkey", "l_linenumber")


@query(
    "f12c_between",
    """
    select o_orderkey from orders where o_custkey between 100 and 900
    and o_orderdate between timestamp '1995-01-01' and timestamp '1998-12-31'
    """,
)
def between(t):
    rules = [
        FilterRule("o_custkey", "between", "(100, 900)"),
        FilterRule("o_orderdate", "between", "(1995-01-01, 1998-12-31)"),
    ]
    return apply_filters(t.orders, rules).select("o_orderkey")


@query(
    "f12d_in",
    "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') "
    "and c_nationkey in (1, 2, 3)",
)
def in_list(t):
    rules = [
        FilterRule("c_mktsegment", "in", "['BUILDING', 'MACHINERY']"),
        FilterRule("c_nationkey", "in", "(1, 2, 3)"),
    ]
    return apply_filters(t.customer, rules).select("c_custkey")


@query("f12e_like", "select p_partkey from part where regexp_matches(p_name, 'ring$')")
def like(t):
    return apply_filters(t.part, [FilterRule("p_name", "like", "ring$")]).select("p_partkey")


@query(
    "f13_computed_filter",
    """
    select l_orderkey, l_linenumber from lineitem
    where l_extendedprice > l_quantity * 1500 and l_tax between l_discount / 2 and 0.07
    """,
)
def computed_filter(t):
    rules = [
        FilterRule("l_extendedprice", "gt", "ds.l_quantity * 1500"),
        FilterRule("l_tax", "between", "(ds.l_discount / 2, 0.07)"),
    ]
    return apply_filters(t.lineitem, rules).select("l_orderkey", "l_linenumber")


@query(
    "f14_custom_comparator",
    "select l_orderkey, l_linenumber from lineitem where l_extendedprice > 2 * l_quantity * 1000",
)
def custom_comparator(t):
    more_than_double = cmp.create_operator(lambda a, b: a > 2 * b)
    condition = more_than_double("l_extendedprice", F.col("l_quantity") * 1000)
    return t.lineitem.filter(condition).select("l_orderkey", "l_linenumber")


@query("f14_python_comparator", "select p_partkey, p_name > p_type as after from part")
def python_comparator(t):
    after = cmp.create_operator(lambda a, b: a > b, python=True)
    return t.part.select("p_partkey", after("p_name", F.col("p_type")).alias("after"))
