"""Tables derived from the test tables that several queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def money(column: str) -> Column:
    """Exact decimals, so that sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def exact_mean(column: str) -> Column:
    return F.sum(money(column)).cast("double") / F.count(column)


def threshold_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Master, set and threshold tables made from the parts.

    Every fifth value is a whole number, a decimal, a boolean, a text, and a text
    declared as a whole number.
    """
    part = t.part
    master = part.select(
        F.col("p_brand").alias("TSHLD_SET_NAME"),
        (F.col("p_size") % 5).alias("TSHLD_SET_TEMPLATE_ID"),
        F.col("p_partkey").alias("TSHLD_ID"),
    )
    sets = part.select(
        (F.col("p_size") % 5).alias("TSHLD_SET_TEMPLATE_ID"),
        F.col("p_size").alias("TSHLD_SET_ID"),
    ).distinct()
    kind = F.col("p_partkey") % 5
    value = (
        F.when(kind == 0, F.col("p_size").cast("string"))
        .when(kind == 1, F.concat((F.col("p_size") * 2).cast("string"), F.lit(".25")))
        .when(kind == 2, F.when(F.col("p_size") > 25, "TRUE").otherwise("false"))
        .when(kind == 3, F.col("p_name"))
        .otherwise("n/a")
    )
    value_type = (
        F.when(kind == 1, "float").when(kind == 2, "Boolean").when(kind == 3, "string")
        .otherwise("integer")
    )
    thresholds = part.select(
        F.col("p_partkey").alias("TSHLD_ID"),
        F.col("p_size").alias("TSHLD_SET_ID"),
        F.col("p_type").alias("TSHLD_TYPE"),
        F.col("p_name").alias("TSHLD_NAME"),
        value.alias("THSLD_VALUE"),
        value_type.alias("VALUE_TYPE"),
    )
    return master, sets, thresholds


# The same three tables for the SQL side, as common table expressions.
THRESHOLD_TABLES = """
master as (
  select p_brand as TSHLD_SET_NAME, p_size % 5 as TSHLD_SET_TEMPLATE_ID,
         p_partkey as TSHLD_ID from part),
sets as (
  select distinct p_size % 5 as TSHLD_SET_TEMPLATE_ID, p_size as TSHLD_SET_ID from part),
thresholds as (
  select p_partkey as TSHLD_ID, p_size as TSHLD_SET_ID, p_type as TSHLD_TYPE,
         p_name as TSHLD_NAME,
         case p_partkey % 5 when 0 then cast(p_size as varchar)
              when 1 then cast(p_size * 2 as varchar) || '.25'
              when 2 then case when p_size > 25 then 'TRUE' else 'false' end
              when 3 then p_name else 'n/a' end as THSLD_VALUE,
         case p_partkey % 5 when 1 then 'float' when 2 then 'Boolean' when 3 then 'string'
              else 'integer' end as VALUE_TYPE
  from part),
joined as (
  select m.TSHLD_SET_NAME, h.TSHLD_TYPE, h.TSHLD_NAME, h.THSLD_VALUE, h.VALUE_TYPE,
         h.TSHLD_ID, h.TSHLD_SET_ID,
         cast(h.TSHLD_ID as varchar) || '_' || cast(h.TSHLD_SET_ID as varchar) as COMPOSITE_KEY
  from master m
  join sets s on m.TSHLD_SET_TEMPLATE_ID = s.TSHLD_SET_TEMPLATE_ID
  join thresholds h on m.TSHLD_ID = h.TSHLD_ID and s.TSHLD_SET_ID = h.TSHLD_SET_ID)"""


def order_lists(t: Tables, item: Column) -> DataFrame:
    """Per order the distinct items of its lines, sorted, as comma-separated text.

    The set is built in the pre-aggregation and holds at most one entry per brand
    and type, however many lines an order has.
    """
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    )
    items = F.array_sort(F.collect_set(item))
    return lines.groupBy("l_orderkey").agg(F.array_join(items, ",").alias("items"))


def brand_lists(t: Tables) -> DataFrame:
    """Brands per order, and the order's wanted brands: one of them or another one."""
    lists = order_lists(t, F.col("p_brand"))
    first = F.substring_index("items", ",", 1)
    last = F.substring_index("items", ",", -1)
    other = F.concat(F.lit("Brand#"), (F.col("l_orderkey") % 30).cast("string"))
    wanted = F.concat(last, F.lit(", "), F.when(F.col("l_orderkey") % 2 == 0, first).otherwise(other))
    return lists.withColumn("wanted", wanted)


BRAND_LISTS = """
lists as (
  select l_orderkey, array_to_string(list_sort(list(distinct p_brand)), ',') as items
  from lineitem join part on l_partkey = p_partkey group by l_orderkey),
brands as (
  select l_orderkey, items,
         string_split(items, ',')[-1] || ', ' ||
         case when l_orderkey % 2 = 0 then string_split(items, ',')[1]
              else 'Brand#' || cast(l_orderkey % 30 as varchar) end as wanted
  from lists)"""


def pair_lists(t: Tables) -> DataFrame:
    """Type and brand pairs per order: plain in ``a``, some turned round in ``b``."""
    swapped = F.col("l_partkey") % 2 == 1
    plain = F.concat_ws("/", "p_type", "p_brand")
    turned = F.when(swapped, F.concat_ws("/", "p_brand", "p_type")).otherwise(plain)
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    )
    return lines.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set(plain)), ",").alias("a"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 7 != 0, turned))), ","
        ).alias("b"),
    )


PAIR_LISTS = """
pairs as (
  select l_orderkey,
         array_to_string(list_sort(list(distinct p_type || '/' || p_brand)), ',') as a,
         coalesce(array_to_string(list_sort(list(distinct
           case when l_partkey % 2 = 1 then p_brand || '/' || p_type
                else p_type || '/' || p_brand end)
           filter (where l_partkey % 7 <> 0)), ','), '') as b
  from lineitem join part on l_partkey = p_partkey group by l_orderkey)"""


def daily_events(t: Tables) -> DataFrame:
    return t.events.withColumn("day", F.col("ts").cast("date"))


LAST_OF_DAY = """
select user_id, cast(ts as date) as day,
       last(event_type order by ts, event_id) as event_type,
       last(value order by ts, event_id) as value
from events group by 1, 2"""
