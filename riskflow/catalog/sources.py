"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import decoded_base64
from ..operators import nesting
from ..plans.static_thresholds import threshold_rows_sql
from ..sources import json_records, rules_xml, sql_store, synthetic, tables
from .registry import query
from .shared import LAST_OF_DAY, THRESHOLD_TABLES, daily_events, threshold_tables


@query(
    "s1_parquet_scan",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 400000",
)
def parquet_scan(t):
    orders = tables.read_parquet(t.spark, f"{t.folder}/orders.parquet")
    return orders.filter(F.col("o_totalprice") > 400000).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query("s2_parquet_read", "select * from part")
def parquet_read(t):
    return tables.read_parquet(t.spark, f"{t.folder}/part.parquet")


@query("s3_csv_read", "select * from customer")
def csv_read(t):
    path = t.new_folder("csv")
    tables.write_csv(t.customer, path)
    return tables.read_csv(t.spark, path, t.customer.schema)


@query(
    "s4_xml_rules",
    """
    select 'ds_' || c_mktsegment as dataset_id, c_name as key, 'gt' as operator,
           cast(c_nationkey as varchar) as filter_value, 'mean, std' as functions,
           v.name as name, 'float64' as type, v.expression as expression
    from customer, (values ('ub', 'derived.mean + derived.std * 3'),
                           ('lb', 'derived.mean < 5')) v(name, expression)
    """,
)
def xml_rules(t):
    def value(name, expression):
        return F.struct(
            F.lit(expression).alias("_VALUE"), F.lit(name).alias("_name"), F.lit("float64").alias("_type")
        )

    values = F.array(value("ub", "derived.mean + derived.std * 3"), value("lb", "derived.mean < 5"))
    condition = F.struct(
        F.lit("c_acctbal").alias("Column"),
        F.lit("gt").alias("Operator"),
        F.col("c_nationkey").cast("string").alias("Value"),
    )
    calculations = t.customer.select(
        F.concat(F.lit("ds_"), "c_mktsegment").alias("DatasetId"),
        F.struct(F.array("c_name").alias("Key")).alias("Keys"),
        F.struct(F.array(condition).alias("Filter")).alias("Filters"),
        F.struct(
            F.lit("c_acctbal").alias("Column"), F.lit("mean, std").alias("GroupFunction")
        ).alias("DerivedValues"),
        F.struct(values.alias("Value")).alias("Values"),
    )
    path = t.new_folder("xml")
    rules_xml.write_calculations(calculations, path)
    rows = rules_xml.read_calculations(t.spark, path)
    return rows.select(
        F.col("DatasetId").alias("dataset_id"),
        F.col("Keys.Key")[0].alias("key"),
        F.col("Filters.Filter")[0]["Operator"].alias("operator"),
        F.col("Filters.Filter")[0]["Value"].alias("filter_value"),
        F.col("DerivedValues.GroupFunction").alias("functions"),
        F.explode("Values.Value").alias("v"),
    ).select(
        "dataset_id", "key", "operator", "filter_value", "functions",
        F.col("v._name").alias("name"), F.col("v._type").alias("type"),
        F.col("v._VALUE").alias("expression"),
    )


@query(
    "s4_xml_text",
    """
    select c_custkey, c_mktsegment as dataset_id, c_name as key, 'customer:c_name' as retained
    from customer
    """,
)
def xml_text(t):
    rule = F.concat(
        F.lit("<Rule><DynamicThresholdCalculations><Calculation><DatasetId>"),
        "c_mktsegment",
        F.lit("</DatasetId><Keys><Key>"),
        "c_name",
        F.lit("</Key></Keys></Calculation></DynamicThresholdCalculations>"),
        F.lit("<RetainedColumns><Column>customer:c_name</Column></RetainedColumns></Rule>"),
    )
    rules = t.customer.select("c_custkey", rules_xml.parse_rule(rule).alias("rule"))
    return rules.select(
        "c_custkey",
        F.col("rule.DynamicThresholdCalculations.Calculation")[0]["DatasetId"].alias("dataset_id"),
        F.col("rule.DynamicThresholdCalculations.Calculation")[0]["Keys"]["Key"][0].alias("key"),
        F.col("rule.RetainedColumns.Column")[0].alias("retained"),
    )


@query(
    "s5_json_ingest",
    """
    select event_id, event_type from events
    union all select event_id, 'second' from events where event_id % 2 = 1
    """,
)
def json_ingest(t):
    record = F.to_json(F.struct("event_id", "event_type"))
    second = F.to_json(F.struct("event_id", F.lit("second").alias("event_type")))
    many = F.concat(F.lit("["), record, F.lit(","), second, F.lit("]"))
    path = t.new_folder("landed")
    t.events.select(F.when(F.col("event_id") % 2 == 1, many).otherwise(record)).write.text(path)
    records = json_records.with_record_ids(json_records.ingest_json(t.spark, path))
    parsed = F.from_json("data", "event_id bigint, event_type string")
    return records.select(parsed.alias("r")).select("r.*")


@query("s6_threshold_sql", f"with {THRESHOLD_TABLES} select * from joined")
def threshold_sql(t):
    return threshold_rows_sql(t.spark, *threshold_tables(t))


@query(
    "s7_parquet_sink",
    "select * from lineitem",
)
def parquet_sink(t):
    path = t.new_folder("parquet")
    tables.write_parquet(t.lineitem, path)
    return tables.read_parquet(t.spark, path)


@query("s8_csv_sink", "select doc_id, text, lang, source, n_chars from documents")
def csv_sink(t):
    path = t.new_folder("csv")
    documents = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    tables.write_csv(documents, path)
    return tables.read_csv(t.spark, path, documents.schema, line_breaks=True)


@query("s9_nested_json", LAST_OF_DAY)
def nested_json(t):
    path = t.new_folder("json")
    nested = nesting.nested_json(
        daily_events(t), "user_id", "day", ["event_type", "value"], ["ts", "event_id"]
    )
    tables.write_json_text(nested, path)
    schema = "map<string, map<string, struct<event_type: string, value: double>>>"
    documents = t.spark.read.text(path).select(F.from_json("value", schema).alias("doc"))
    accounts = documents.select(F.explode("doc").alias("account", "days"))
    return accounts.select("account", F.explode("days").alias("day", "f")).select(
        F.col("account").cast("bigint").alias("user_id"),
        F.col("day").cast("date").alias("day"),
        "f.event_type",
        "f.value",
    )


# The words of the generated columns.
CHOICES = ["cat", "dog", "lion", "tiger", "wolf", "elephant", "bear", "fox"]
TAGS = ["ml", "ai", "cv", "nlp", "robotics", "math", "bio", "chem", "astro"]


def _pick_sql(stream: int, size: int) -> str:
    digits = f"substr(md5(o_orderkey || ':42:{stream}'), 1, 15)"
    return f"cast(cast('0x' || {digits} as bigint) % {size} as int)"


@query(
    "s11_synthetic_columns",
    f"""
    select o_orderkey, {CHOICES}[{_pick_sql(1, 8)} + 1] as animal,
           array_to_string(list_transform(list_slice(list_sort(list_transform({TAGS},
               lambda x: {{'h': md5(o_orderkey || ':42:2:' || x), 'item': x}})),
               1, {_pick_sql(3, 6)}), lambda e: e.item), ',') as tags
    from orders
    """,
)
def synthetic_columns(t):
    ids = t.orders.select("o_orderkey")
    filled = synthetic.with_choice(ids, "o_orderkey", "animal", CHOICES)
    filled = synthetic.with_sample(filled, "o_orderkey", "tags", TAGS)
    return filled.withColumn("tags", F.array_join("tags", ","))


NAMED_SQL = {
    "returns_by_supplier": """
        select l_suppkey, l_returnflag, count(*) as lines, max(l_shipdate) as last_shipdate
        from {lineitem} group by l_suppkey, l_returnflag
    """
}


@query(
    "s12_named_query",
    """
    select l_suppkey, l_returnflag, count(*) as lines, max(l_shipdate) as last_shipdate
    from lineitem group by l_suppkey, l_returnflag
    """,
)
def named_query(t):
    return sql_store.run_named(t.spark, NAMED_SQL, "returns_by_supplier", {"lineitem": t.lineitem})


@query(
    "s13_base64",
    """
    select p_partkey, case when p_partkey % 10 = 0 then null else p_name end as decoded,
           p_partkey % 10 = 0 as is_bad
    from part
    """,
)
def base64_text(t):
    encoded = F.base64(F.col("p_name").cast("binary"))
    damaged = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("!!"), encoded)).otherwise(encoded)
    decoded = t.part.select("p_partkey", decoded_base64(damaged).alias("bytes"))
    return decoded.select(
        "p_partkey", F.col("bytes").cast("string").alias("decoded"), F.isnull("bytes").alias("is_bad")
    )


@query(
    "x1_to_json",
    "select event_id, cast(to_json({'id': event_id, 't': event_type}) as varchar) as json from events",
)
def record_to_json(t):
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"))
    return t.events.select("event_id", F.to_json(record).alias("json"))


@query(
    "x2_from_json",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
)
def record_from_json(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
