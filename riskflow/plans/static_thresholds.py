"""Static thresholds from their three tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import typed_value
from ..functions.columns import composite_key

# Table and column names of the threshold tables, spelled as stored.
THRESHOLD_SQL = """
select master.TSHLD_SET_NAME, t.TSHLD_TYPE, t.TSHLD_NAME, t.THSLD_VALUE, t.VALUE_TYPE,
       t.TSHLD_ID, t.TSHLD_SET_ID,
       cast(t.TSHLD_ID as string) || '_' || cast(t.TSHLD_SET_ID as string) as COMPOSITE_KEY
from {thresholds} as t
join {master} as master on master.TSHLD_ID = t.TSHLD_ID
join {sets} as sets on sets.TSHLD_SET_TEMPLATE_ID = master.TSHLD_SET_TEMPLATE_ID
                   and sets.TSHLD_SET_ID = t.TSHLD_SET_ID
"""

VALUE_COLUMNS = ("value_long", "value_double", "value_bool", "value_string")


def threshold_rows_sql(
    spark: SparkSession, master: DataFrame, sets: DataFrame, thresholds: DataFrame
) -> DataFrame:
    """The thresholds of every set, by SQL."""
    return spark.sql(THRESHOLD_SQL, master=master, sets=sets, thresholds=thresholds)


def threshold_rows(master: DataFrame, sets: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The thresholds of every set: name, type, value text and its declared type.

    Thresholds join their master rows first: masters and sets alone pair up many to
    many.
    """
    named = thresholds.join(
        master.select("TSHLD_ID", "TSHLD_SET_TEMPLATE_ID", "TSHLD_SET_NAME"), "TSHLD_ID"
    )
    rows = named.join(
        sets.select("TSHLD_SET_TEMPLATE_ID", "TSHLD_SET_ID"),
        ["TSHLD_SET_TEMPLATE_ID", "TSHLD_SET_ID"],
    )
    return rows.select(
        "TSHLD_SET_NAME",
        "TSHLD_TYPE",
        "TSHLD_NAME",
        "THSLD_VALUE",
        "VALUE_TYPE",
        "TSHLD_ID",
        "TSHLD_SET_ID",
        composite_key("TSHLD_ID", "TSHLD_SET_ID").alias("COMPOSITE_KEY"),
    )


def typed_thresholds(
    rows: DataFrame, order_by: Sequence[str] = ("TSHLD_ID", "TSHLD_SET_ID")
) -> DataFrame:
    """One typed value per set, type and name; the last row by ``order_by`` wins."""
    values = typed_value("THSLD_VALUE", "VALUE_TYPE")
    entry = F.struct(*[values[name].alias(name) for name in VALUE_COLUMNS])
    # Equal order values are decided by the value text, so that reruns agree.
    order = F.struct(*order_by, "THSLD_VALUE", "VALUE_TYPE")
    return (
        rows.groupBy("TSHLD_SET_NAME", "TSHLD_TYPE", "TSHLD_NAME")
        .agg(F.max_by(entry, order).alias("value"))
        .select("TSHLD_SET_NAME", "TSHLD_TYPE", "TSHLD_NAME", "value.*")
    )


def nested_thresholds(typed: DataFrame) -> DataFrame:
    """One row per set: a map from type to a map from name to value.

    Values are variants, so that each keeps its own type in JSON.
    """
    value = F.coalesce(
        F.col("value_long").cast("variant"),
        F.col("value_double").cast("variant"),
        F.col("value_bool").cast("variant"),
        F.col("value_string").cast("variant"),
    )
    by_name = typed.groupBy("TSHLD_SET_NAME", "TSHLD_TYPE").agg(
        F.map_from_entries(F.collect_list(F.struct("TSHLD_NAME", value))).alias("names")
    )
    return by_name.groupBy("TSHLD_SET_NAME").agg(
        F.map_from_entries(F.collect_list(F.struct("TSHLD_TYPE", "names"))).alias("thresholds")
    )


def threshold_struct(
    typed: DataFrame, set_name: str, threshold_type: str, types: Mapping[str, str]
) -> DataFrame:
    """One row with one struct: the named thresholds of a set and type, as ``types``."""
    fields = []
    for name, type_name in types.items():
        here = F.col("TSHLD_NAME") == name
        text = F.coalesce(*[F.col(c).cast("string") for c in VALUE_COLUMNS])
        fields.append(F.max(F.when(here, text)).cast(type_name).alias(name))
    chosen = typed.filter(
        (F.col("TSHLD_SET_NAME") == set_name) & (F.col("TSHLD_TYPE") == threshold_type)
    )
    return chosen.agg(F.struct(*fields).alias("static_thresholds"))


def attach_static_thresholds(events: DataFrame, one_row: DataFrame) -> DataFrame:
    """Give every event the one-row struct, as a scalar subquery rather than a join."""
    thresholds: Column = one_row.select("static_thresholds").scalar()
    return events.withColumn("static_thresholds", thresholds)
