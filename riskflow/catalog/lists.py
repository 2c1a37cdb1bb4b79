"""Lists in text and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists
from .registry import query
from .shared import BRAND_LISTS, PAIR_LISTS, brand_lists, pair_lists


def _contains_all(items: str, wanted: str) -> str:
    return f"len(list_filter({wanted}, lambda w: not list_contains({items}, w))) = 0"


def _trimmed(text: str) -> str:
    return f"list_transform(string_split({text}, ','), lambda x: trim(x))"


@query(
    "l1_list_in_literal",
    f"with {BRAND_LISTS} select l_orderkey, "
    + _contains_all("string_split(items, ',')", "['Brand#1', 'Brand#2']")
    + " as hit from brands",
)
def list_in_literal(t):
    return brand_lists(t).select(
        "l_orderkey", lists.list_in("items", " Brand#2,Brand#1 ,").alias("hit")
    )


@query(
    "l2_list_in_column",
    f"with {BRAND_LISTS} select l_orderkey, "
    + _contains_all("string_split(items, ',')", _trimmed("wanted"))
    + " as hit from brands",
)
def list_in_column(t):
    return brand_lists(t).select(
        "l_orderkey", lists.list_in("items", F.col("wanted")).alias("hit")
    )


@query(
    "l3_list_in_python_list",
    f"with {BRAND_LISTS} select l_orderkey from brands where "
    + _contains_all("string_split(items, ',')", "['Brand#3']"),
)
def list_in_python_list(t):
    return brand_lists(t).filter(lists.list_in("items", [" Brand#3"])).select("l_orderkey")


@query(
    "l4_list_in_blanks",
    f"with {BRAND_LISTS} select l_orderkey, "
    + _contains_all("string_split(items, ',')", "[string_split(items, ',')[1]]")
    + " as dropped, false as kept from brands",
)
def list_in_blanks(t):
    wanted = F.concat(F.substring_index("items", ",", 1), F.lit(",,"))
    return brand_lists(t).select(
        "l_orderkey",
        lists.list_in("items", wanted).alias("dropped"),
        lists.list_in("items", wanted, drop_blank=False).alias("kept"),
    )


@query(
    "l5_list_in_untrimmed",
    f"with {BRAND_LISTS} select l_orderkey, "
    + _contains_all("string_split(items, ',')", "string_split(wanted, ',')")
    + " as hit from brands",
)
def list_in_untrimmed(t):
    hit = lists.list_in("items", F.col("wanted"), trim=False, drop_blank=False)
    return brand_lists(t).select("l_orderkey", hit.alias("hit"))


def _pairs(text: str) -> str:
    turned = "array_to_string(list_sort(string_split(p, '/')), '/')"
    return f"list_transform(string_split({text}, ','), lambda p: {turned})"


@query(
    "l7_list_not_in_list",
    f"with {PAIR_LISTS} select l_orderkey, not ("
    + _contains_all(_pairs("b"), _pairs("a"))
    + ") as mismatch from pairs",
)
def list_not_in_list(t):
    mismatch = lists.list_not_in_list("a", F.col("b"))
    return pair_lists(t).select("l_orderkey", mismatch.alias("mismatch"))


@query(
    "l7_list_not_in_literal",
    f"with {PAIR_LISTS} select l_orderkey, not ("
    + _contains_all("['Brand#1/ECONOMY', 'Brand#2/ECONOMY']", _pairs("a"))
    + ") as mismatch from pairs",
)
def list_not_in_literal(t):
    mismatch = lists.list_not_in_list("a", "ECONOMY/Brand#1,Brand#2/ECONOMY")
    return pair_lists(t).select("l_orderkey", mismatch.alias("mismatch"))


@query(
    "l8_normalize_pairs",
    """
    select p_partkey, array_to_string(list_sort([p_type, p_brand]), '/') || '|' ||
           array_to_string(list_sort([p_brand, replace(p_name, ' ', '')]), '/') as pairs
    from part
    """,
)
def normalize_pairs(t):
    text = F.concat(
        F.lit(" "), "p_type", F.lit(" / "), "p_brand", F.lit("\t; "), "p_name", F.lit("/"), "p_brand"
    )
    pairs = lists.normalize_pair_list(text, more_separators=[";"])
    return t.part.select("p_partkey", F.array_join(pairs, "|").alias("pairs"))


@query(
    "l9_split",
    """
    select p_partkey, cast(len(string_split(p_name || '.' || p_brand || '.', '.')) as bigint) as n,
           string_split(p_name || '.' || p_brand || '.', '.')[2] as second
    from part
    """,
)
def split(t):
    parts = lists.split_list(F.concat("p_name", F.lit("."), "p_brand", F.lit(".")), ".")
    return t.part.select(
        "p_partkey", F.size(parts).cast("bigint").alias("n"), parts[1].alias("second")
    )


@query(
    "l10_map_items",
    "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), "
    "lambda x: upper(x)), '+') as words from part",
)
def map_items(t):
    words = lists.map_items(lists.split_list("p_name", " "), F.upper)
    return t.part.select("p_partkey", F.array_join(words, "+").alias("words"))


@query(
    "l11_sort_join",
    "select p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), '/') as words from part",
)
def sort_join(t):
    return t.part.select("p_partkey", lists.sorted_pair(F.col("p_name"), " ").alias("words")).withColumn(
        "words", F.array_join(lists.split_list("words", " "), "/")
    )


@query(
    "l12_missing_items",
    f"""
    with {BRAND_LISTS}
    select l_orderkey, cast(len(list_filter(list_distinct({_trimmed('wanted')}),
           lambda w: not list_contains(string_split(items, ','), w))) as bigint) as missing
    from brands
    """,
)
def missing_items(t):
    missing = lists.items_missing_from(lists.list_items("wanted"), lists.list_items("items"))
    return brand_lists(t).select("l_orderkey", F.size(missing).cast("bigint").alias("missing"))


@query(
    "l13_all_true",
    f"""
    with {BRAND_LISTS}
    select l_orderkey, len(list_filter(string_split(items, ','),
           lambda x: not starts_with(x, 'Brand#1'))) = 0 as all_ones
    from brands
    """,
)
def all_true(t):
    tests = lists.map_items(lists.list_items("items"), lambda x: x.startswith("Brand#1"))
    return brand_lists(t).select("l_orderkey", lists.all_true(tests).alias("all_ones"))


@query(
    "l14_element_in_list",
    "select p_partkey, list_contains(string_split(p_name, ' '), 'ring') as hit from part",
)
def element_in_list(t):
    hit = F.array_contains(lists.split_list("p_name", " "), "ring")
    return t.part.select("p_partkey", hit.alias("hit"))


@query(
    "l15_regex_replace",
    r"""
    select doc_id, md5(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) as digest
    from documents
    """,
)
def regex_replace(t):
    packed = F.regexp_replace("text", r"\s+", "")
    return t.documents.select("doc_id", F.md5(packed.cast("binary")).alias("digest"))


@query(
    "l16_trim_items",
    """
    select p_partkey, array_to_string(list_transform(string_split(' ' || p_name || ' ; ' || p_brand, ';'),
           lambda x: trim(x)), ';') as items from part
    """,
)
def trim_items(t):
    text = F.concat(F.lit("\t\n "), "p_name", F.lit(" \r\n;\t"), "p_brand", F.lit("\n"))
    items = lists.list_items(text, ";", drop_blank=False)
    return t.part.select("p_partkey", F.array_join(items, ";").alias("items"))
