"""Whole workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Calculation, Dataset, DerivedValues, EventTable, FilterRule, ThresholdValue
from ..plans import bank_report as bank
from ..plans.dynamic_thresholds import dynamic_threshold
from ..plans.event_level import event_level
from ..plans.rule_flags import flagged, with_flag
from ..plans.static_thresholds import (
    attach_static_thresholds,
    threshold_rows,
    threshold_struct,
    typed_thresholds,
)
from ..sources import versions
from ..sources.tables import read_csv
from ..streaming import staging
from .registry import query
from .shared import THRESHOLD_TABLES, money, threshold_tables

BANK_REPORT = """
select p_brand as category,
       case when l_extendedprice > 50000 then 'Yes' else 'No' end as high_value_transaction,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total_amount,
       count(l_orderkey) as transaction_count,
       cast(sum(cast(s_acctbal as decimal(18,2))) as double) / count(s_acctbal) as avg_balance,
       count(distinct s_suppkey) as unique_accounts,
       count(distinct p_partkey) as unique_merchants
from supplier join lineitem on s_suppkey = l_suppkey join part on l_partkey = p_partkey
group by 1, 2
"""


def bank_tables(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    accounts = t.supplier.select(
        F.col("s_suppkey").alias("account_id"), money("s_acctbal").alias("balance")
    )
    transactions = t.lineitem.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_partkey").alias("merchant_id"),
        money("l_extendedprice").alias("amount"),
    )
    merchants = t.part.select(
        F.col("p_partkey").alias("merchant_id"), F.col("p_brand").alias("category")
    )
    return accounts, transactions, merchants


@query("bank_report", BANK_REPORT)
def bank_report(t):
    report = bank.bank_report(*bank_tables(t), threshold=50000)
    return report.withColumn("total_amount", F.col("total_amount").cast("double"))


@query("w1_bank_report_files", BANK_REPORT)
def bank_report_files(t):
    folder = t.new_folder("bank")
    written = bank.write_report(bank.bank_report(*bank_tables(t), threshold=50000), folder)
    report = read_csv(t.spark, f"{folder}/grouped_data.csv", written.schema)
    return report.withColumn("total_amount", F.col("total_amount").cast("double"))


@query("w1_report_versions", BANK_REPORT)
def report_versions(t):
    """The newest of two published reports, read as CSV."""
    folder = t.new_folder("reports")
    bank.publish_report(bank.bank_report(*bank_tables(t), threshold=1), folder)
    written = bank.publish_report(bank.bank_report(*bank_tables(t), threshold=50000), folder)
    report = read_csv(t.spark, versions.current(folder, bank.CSV_NAME), written.schema)
    return report.withColumn("total_amount", F.col("total_amount").cast("double"))


# Three calculations: two over one dataset with different filters, and one that takes
# its dataset's column as it is.
CALCULATIONS = [
    Calculation(
        dataset_id="history",
        keys=("o_custkey",),
        filters=(FilterRule("o_orderstatus", "eq", "F"),),
        derived=DerivedValues("o_totalprice", ("mean", "std")),
        values=(
            ThresholdValue("upper", "float64", "derived.mean + derived.std * th.std_cycles"),
            ThresholdValue("cycles", "int32", "3"),
        ),
    ),
    Calculation(
        dataset_id="history",
        keys=("o_custkey",),
        filters=(FilterRule("o_orderstatus", "in", "['O', 'P']"),),
        derived=DerivedValues("o_totalprice", ("count", "max", "median", "last")),
        values=(ThresholdValue("label", "str", "derived.count"),),
    ),
    Calculation(
        dataset_id="accounts",
        keys=("c_custkey",),
        derived=DerivedValues("c_acctbal"),
        values=(ThresholdValue("cover", "float64", "ds.c_acctbal / (ev.o_custkey % 4)"),),
    ),
    Calculation(
        dataset_id="accounts",
        keys=("c_custkey",),
        filters=(FilterRule("c_mktsegment", "neq", "BUILDING"),),
        derived=DerivedValues("c_acctbal", ("min",)),
        values=(ThresholdValue("lower", "float64", "derived.min - dth.cycles"),),
    ),
]


def events_with_thresholds(t) -> DataFrame:
    events = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    static = F.struct(F.lit(2).alias("std_cycles"))
    datasets = {
        "history": Dataset(t.orders, ("o_custkey",), ("o_orderdate", "o_orderkey")),
        "accounts": Dataset(t.customer, ("c_custkey",)),
    }
    table = EventTable(events.withColumn("static_thresholds", static), ("o_custkey",))
    return dynamic_threshold({"orders": table}, datasets, CALCULATIONS)["orders"].df


DYNAMIC = """
f as (select o_custkey as k, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as std
      from orders where o_orderstatus = 'F' group by 1),
o as (select o_custkey as k, count(o_totalprice) as count, max(o_totalprice) as max,
             median(o_totalprice) as median,
             last(o_totalprice order by o_orderdate, o_orderkey) as last
      from orders where o_orderstatus in ('O', 'P') group by 1),
c as (select c_custkey as k, c_acctbal as bal,
             case when c_mktsegment <> 'BUILDING' then c_acctbal end as min from customer),
thresholds as (
  select o_orderkey, o_custkey, o_totalprice, f.mean, f.std, o.count, o.max, o.median, o.last,
         c.bal as c_acctbal, c.min, f.mean + f.std * 2 as upper, 3 as cycles,
         cast(o.count as varchar) as label, c.bal / nullif(o_custkey % 4, 0) as cover,
         c.min - 3 as lower
  from orders left join f on f.k = o_custkey left join o on o.k = o_custkey
  left join c on c.k = o_custkey)"""


@query(
    "w2_dynamic_threshold",
    f"""
    with {DYNAMIC}
    select o_orderkey, count, max, median, last, c_acctbal, min, round(upper, 2) as upper, cycles,
           label, cover, lower
    from thresholds
    """,
)
def dynamic(t):
    return events_with_thresholds(t).select(
        "o_orderkey",
        *[f"derived_values.{n}" for n in ("count", "max", "median", "last", "c_acctbal", "min")],
        F.round("dynamic_thresholds.upper", 2).alias("upper"),
        *[f"dynamic_thresholds.{n}" for n in ("cycles", "label", "cover", "lower")],
    )


@query(
    "w3_event_level",
    """
    select l_orderkey, l_extendedprice, o_totalprice, o_orderdate, c_name, c_nationkey
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    """,
)
def event_table(t):
    # A chain joins by one key list per dataset; customers have another key than lines,
    # so they are a second chain.
    datasets = {
        "lines": Dataset(t.lineitem, ("l_orderkey",)),
        "orders": Dataset(t.orders, ("o_orderkey",)),
    }
    columns = ["lines:l_orderkey", "lines:l_extendedprice", "orders:o_totalprice",
               "orders:o_orderdate", "orders:o_custkey"]
    events = event_level(columns, datasets)
    datasets = {
        "events": Dataset(events, ("o_custkey",)),
        "customers": Dataset(t.customer, ("c_custkey",)),
    }
    return event_level(
        ["events:l_orderkey", "events:l_extendedprice", "events:o_totalprice", "events:o_orderdate",
         "customers:c_name", "customers:c_nationkey"],
        datasets,
    )


@query(
    "w4_static_thresholds",
    f"""
    with {THRESHOLD_TABLES},
    latest as (
      select TSHLD_SET_NAME as set_name, TSHLD_TYPE as type, TSHLD_NAME as name,
             last(THSLD_VALUE order by TSHLD_ID, TSHLD_SET_ID) as v,
             last(VALUE_TYPE order by TSHLD_ID, TSHLD_SET_ID) as vt
      from joined group by 1, 2, 3)
    select set_name, type, name,
           case when vt = 'integer' then try_cast(v as bigint) end as value_long,
           case when vt = 'float' then try_cast(v as double) end as value_double,
           case when vt = 'Boolean' then lower(v) = 'true' end as value_bool,
           case when vt = 'string' or v = 'n/a' then v end as value_string
    from latest
    """,
)
def static_thresholds(t):
    typed = typed_thresholds(threshold_rows(*threshold_tables(t)))
    return typed.toDF("set_name", "type", "name", *typed.columns[3:])


@query(
    "w4_static_struct",
    f"""
    with {THRESHOLD_TABLES},
    latest as (
      select TSHLD_NAME as name,
             last(case when VALUE_TYPE = 'Boolean' then lower(THSLD_VALUE) else THSLD_VALUE end
                  order by TSHLD_ID, TSHLD_SET_ID) as v
      from joined where TSHLD_SET_NAME = 'Brand#1' and TSHLD_TYPE = 'ECONOMY' group by 1)
    select p_partkey, p_size,
           (select max(v) from latest where name = 'small ring') as small_ring,
           (select max(v) from latest where name = 'large ring') as large_ring
    from part
    """,
)
def static_struct(t):
    typed = typed_thresholds(threshold_rows(*threshold_tables(t)))
    one_row = threshold_struct(
        typed, "Brand#1", "ECONOMY", {"small ring": "string", "large ring": "string"}
    )
    events = attach_static_thresholds(t.part.select("p_partkey", "p_size"), one_row)
    return events.select(
        "p_partkey",
        "p_size",
        F.col("static_thresholds.`small ring`").alias("small_ring"),
        F.col("static_thresholds.`large ring`").alias("large_ring"),
    )


STAGED = "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"


def _land(t) -> str:
    record = F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props")))
    path = t.new_folder("landed")
    t.events.select(record).write.text(path)
    return path


def _process(staged: DataFrame) -> DataFrame:
    record = F.from_json("data", "event_id bigint, props struct<k: bigint>")
    return staged.select(record.alias("r")).select("r.event_id", "r.props.k")


@query("w5_json_staging", STAGED)
def json_staging(t):
    folder = t.new_folder("staging")
    if not staging.run_staging(t.spark, _land(t), folder, _process):
        raise RuntimeError("staged processing failed")
    return t.spark.read.parquet(f"{folder}/results")


@query("w5_json_stream", STAGED)
def json_stream(t):
    folder = t.new_folder("stream")
    staging.start_staging_stream(t.spark, _land(t), folder, _process).awaitTermination()
    staging.start_clean_up_stream(t.spark, folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/results").select("event_id", "k")


FLAG = (
    "(ev.o_totalprice > dth.upper) | "
    "((ev.o_totalprice > derived.median * th.std_cycles) & (derived.count >= 4))"
)


@query(
    "w6_rule_flag",
    f"""
    with {DYNAMIC}
    select o_orderkey, o_totalprice > upper or (o_totalprice > median * 2 and count >= 4) as suspicious
    from thresholds
    """,
)
def rule_flag(t):
    return with_flag(events_with_thresholds(t), "suspicious", FLAG).select("o_orderkey", "suspicious")


@query(
    "w6_flagged_events",
    f"""
    with {DYNAMIC}
    select o_orderkey, o_totalprice from thresholds
    where coalesce(o_totalprice > upper or (o_totalprice > median * 2 and count >= 4), false)
    """,
)
def flagged_events(t):
    events = with_flag(events_with_thresholds(t), "suspicious", FLAG)
    return flagged(events, "suspicious").select("o_orderkey", "o_totalprice")
