"""Projection, casts, structs and config expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Dataset
from ..functions.casts import cast_value, typed_value
from ..functions.columns import composite_key, flag
from ..functions.expressions import config_column
from ..functions.structs import ensure_struct_columns, field, field_names, set_fields, struct_of
from ..operators.columns import cast_columns, rename_by_position
from ..plans.event_level import event_level
from .registry import query
from .shared import THRESHOLD_TABLES, threshold_tables


@query("p1_select", "select c_custkey, c_acctbal from customer")
def select(t):
    return t.customer.select("c_custkey", "c_acctbal")


@query(
    "p2_select_qualified",
    """
    select o_orderkey as key, o_totalprice as amount, l_extendedprice as amount_lines,
           l_linenumber as line
    from orders join lineitem on o_orderkey = l_orderkey
    """,
)
def select_qualified(t):
    orders = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("key"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linenumber").alias("line"),
    )
    datasets = {"orders": Dataset(orders, ("key",)), "lines": Dataset(lines, ("key",))}
    return event_level(["orders:key", "orders:amount", "lines:amount", "lines:line"], datasets)


@query("p3_rename", "select r_regionkey as id, r_name as label from region")
def rename(t):
    return rename_by_position(t.region, ["id", "label"])


@query("p4_alias", "select o_orderkey, o_custkey + 1 as next_custkey from orders")
def alias(t):
    return t.orders.select("o_orderkey", (F.col("o_custkey") + 1).alias("next_custkey"))


@query(
    "p5_flag",
    """
    select l_orderkey, l_linenumber, l_quantity,
           case when nullif(l_quantity, 10) > 25 then 'Yes' else 'No' end as high
    from lineitem
    """,
)
def conditional_flag(t):
    quantity = F.nullif("l_quantity", F.lit(10.0))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", flag(quantity > 25).alias("high")
    )


@query(
    "p6_cast_columns",
    """
    select cast(o_orderkey as integer) as o_orderkey, cast(o_custkey as smallint) as o_custkey,
           o_orderstatus, cast(trunc(o_totalprice) as bigint) as o_totalprice,
           cast(o_orderdate as date) as o_orderdate, o_orderpriority
    from orders
    """,
)
def cast_by_mapping(t):
    mapping = {
        "o_orderkey": "int32",
        "o_custkey": "Int16",
        "o_totalprice": "integer",
        "o_orderdate": "date",
        "o_orderstatus": "no such type",
        "no_such_column": "int32",
    }
    return cast_columns(t.orders, mapping)


@query(
    "p6_cast_wide_types",
    """
    select c_custkey, cast(c_acctbal as float) as as_float, cast(c_nationkey as double) as as_double,
           cast(cast(c_custkey as decimal(20,0)) as double) as as_uint64,
           case when c_acctbal >= 0 then cast(trunc(c_acctbal) as bigint) end as as_uint32,
           c_nationkey <> 0 as as_bool, cast(c_custkey as varchar) as as_text,
           cast(cast(c_acctbal as decimal(38,9)) as double) as as_decimal
    from customer
    """,
)
def cast_wide_types(t):
    balance, nation, key = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    copies = t.customer.select(
        "c_custkey", balance.alias("as_float"), nation.alias("as_double"), key.alias("as_uint64"),
        balance.alias("as_uint32"), nation.alias("as_bool"),
        key.alias("as_text"), balance.alias("as_decimal"),
    )
    strict = {
        "as_float": "float32", "as_double": "double", "as_uint64": "uint64", "as_bool": "bool",
        "as_text": "string", "as_decimal": "decimal",
    }
    cast = cast_columns(cast_columns(copies, strict), {"as_uint32": "uint32"}, strict=False)
    return cast.withColumns(
        {name: F.col(name).cast("double") for name in ("as_uint64", "as_decimal")}
    )


@query(
    "p7_cast_value",
    """
    select o_orderkey, cast(o_totalprice * 2 as float) as f32, cast(o_custkey + 1 as bigint) as i64,
           cast(o_custkey as varchar) as other
    from orders
    """,
)
def cast_computed(t):
    return t.orders.select(
        "o_orderkey",
        cast_value(F.col("o_totalprice") * 2, "float32").alias("f32"),
        cast_value(F.col("o_custkey") + 1, "INT64").alias("i64"),
        cast_value(F.col("o_custkey"), "unheard of").alias("other"),
    )


@query(
    "p8_typed_value",
    f"""
    with {THRESHOLD_TABLES}
    select TSHLD_ID,
           case when VALUE_TYPE = 'integer' then try_cast(THSLD_VALUE as bigint) end as value_long,
           case when VALUE_TYPE = 'float' then try_cast(THSLD_VALUE as double) end as value_double,
           case when VALUE_TYPE = 'Boolean' then lower(THSLD_VALUE) = 'true' end as value_bool,
           case when VALUE_TYPE = 'string' or THSLD_VALUE = 'n/a' then THSLD_VALUE end
             as value_string
    from thresholds
    """,
)
def typed_values(t):
    columns = typed_value("THSLD_VALUE", "VALUE_TYPE")
    return threshold_tables(t)[2].select(
        "TSHLD_ID", *[column.alias(name) for name, column in columns.items()]
    )


@query(
    "p9_literal",
    "select n_nationkey, 7 as seven, 'x' as letter, cast(null as double) as nothing from nation",
)
def literal(t):
    return t.nation.select(
        "n_nationkey",
        F.lit(7).alias("seven"),
        F.lit("x").alias("letter"),
        F.lit(None).cast("double").alias("nothing"),
    )


@query("p10_struct", "select p_partkey, p_brand as brand, p_size as size from part")
def struct(t):
    packed = struct_of({"brand": F.col("p_brand"), "size": F.col("p_size")})
    return t.part.select("p_partkey", packed.alias("s")).select("p_partkey", "s.*")


@query(
    "p11_struct_of_literals",
    "select o_orderkey, 3 as std_cycles, 0.5 :: double as share, 'F' as status from orders",
)
def struct_of_literals(t):
    thresholds = struct_of({"std_cycles": 3, "share": 0.5, "status": "F"})
    return t.orders.select("o_orderkey", thresholds.alias("th")).select("o_orderkey", "th.*")


@query(
    "p12_struct_field",
    "select s_suppkey, s_acctbal * 2 as doubled from supplier",
)
def struct_field(t):
    packed = t.supplier.select("s_suppkey", F.struct("s_acctbal", "s_name").alias("derived_values"))
    return packed.select("s_suppkey", (field("derived_values", "s_acctbal") * 2).alias("doubled"))


@query(
    "p13_set_fields",
    "select s_suppkey, s_name as kept, s_acctbal + 1 as changed, s_nationkey as added from supplier",
)
def set_struct_fields(t):
    base = struct_of({"kept": F.col("s_name"), "changed": F.col("s_acctbal")})
    grown = set_fields(base, {"changed": F.col("s_acctbal") + 1, "added": F.col("s_nationkey")})
    return t.supplier.select("s_suppkey", grown.alias("s")).select("s_suppkey", "s.*")


@query(
    "p14_ensure_struct",
    "select c_custkey, 0 as fields_before, c_acctbal as balance from customer",
)
def ensure_struct(t):
    ensured = ensure_struct_columns(t.customer, "derived_values", "dynamic_thresholds")
    before = len(field_names(ensured, "derived_values"))
    grown = set_fields(F.col("derived_values"), {"balance": F.col("c_acctbal")})
    return ensured.select(
        "c_custkey", F.lit(before).alias("fields_before"), grown.alias("s")
    ).select("c_custkey", "fields_before", "s.balance")


@query(
    "p15_drop",
    "select p_partkey, p_name, p_size, p_retailprice from part",
)
def drop(t):
    return t.part.drop("p_brand", "p_type")


@query(
    "p16_composite_key",
    """
    select o_orderkey, cast(o_custkey as varchar) || '_' || nullif(o_orderstatus, 'P') as key
    from orders
    """,
)
def composite(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", composite_key("o_custkey", status).alias("key"))


@query(
    "p17_expression",
    """
    select o_orderkey, o_totalprice + 2.5 * (o_custkey % 7) as bound,
           o_totalprice / nullif(o_custkey % 3, 0) as ratio,
           o_totalprice > 2 * 60000 and o_orderstatus = 'F' or not (o_custkey >= 100) as flag,
           o_orderpriority in ('1-URGENT', '5-LOW') as edge, 16 as constant,
           o_orderdate >= timestamp '1996-01-08' as late
    from orders
    """,
)
def expression(t):
    prepared = t.orders.withColumns(
        {
            "derived_values": struct_of({"mean": F.col("o_totalprice"), "std": F.col("o_custkey") % 7}),
            "static_thresholds": struct_of({"cycles": 2.5, "limit": 60000}),
        }
    )
    texts = {
        "bound": "derived.mean + th.cycles * derived.std",
        "ratio": "ev.o_totalprice / (ev.o_custkey % 3)",
        "flag": "(ev.o_totalprice > 2 * th.limit) & (ev.o_orderstatus == F) | ~(ev.o_custkey >= 100)",
        "edge": "ds.o_orderpriority in ('1-URGENT', '5-LOW')",
        "constant": "10 + 2 * 3",
        "late": "ev.o_orderdate >= 1996-01-08",
    }
    return prepared.select(
        "o_orderkey", *[config_column(text).alias(name) for name, text in texts.items()]
    )


@query(
    "x4_date_casts",
    """
    select o_orderkey, cast(o_orderdate as date) as day,
           cast(cast(cast(o_orderdate as date) as varchar) as timestamp) as moment
    from orders
    """,
)
def date_casts(t):
    texts = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.col("o_orderdate").cast("date").cast("string").alias("moment"),
    )
    return cast_columns(texts, {"day": "date", "moment": "datetime"})
