"""Decisions about texts applied to the rows that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored


def text_digest(text: Column) -> Column:
    """What stands for a whole text beside its id; null and empty texts are equal."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def rows_decided(docs: DataFrame, decided: DataFrame, id_: Column, key: Column, order: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``decided`` has one row per id and digest of a text (``__id``, ``__key``) of which
    something is decided: whether it stays (``__kept``) and how many rows have both
    (``__copies``). Of several such rows one stays, the first by ``order``. Rows not named
    there stay as they are. An id alone does not tell rows apart: it may be null or repeat.

    The rows are shuffled once; once more only where some repeat and are too many to broadcast.
    """
    columns = [F.col(f"`{name}`") for name in docs.columns]
    order = F.lit(0) if order is None else order
    marked = docs.select(F.struct(*columns).alias("__row"), id_.alias("__id"), key.alias("__key"), order.alias("__order"))
    decided = stored(decided, "decided")
    same = [marked["__id"].eqNullSafe(decided["__id"]), marked["__key"] == decided["__key"]]
    # Joined in one way at all sizes, so that small tables tell what large ones take.
    joined = marked.join(decided.hint("merge"), same, "left")
    once = joined.filter(F.coalesce("__kept", F.lit(True)) & (F.coalesce("__copies", F.lit(1)) == 1)).select("__row.*")
    several = stored(decided.filter("__kept and __copies > 1").select("__id", "__key"), "repeated")
    if several.isEmpty():
        return once
    same = [marked["__id"].eqNullSafe(several["__id"]), marked["__key"] == several["__key"]]
    repeated = marked.join(several, same).select("__row", marked["__id"], marked["__key"], "__order")
    # Tasks keep one of their copies before any are shuffled.
    repeated = repeated.groupBy("__id", "__key").agg(F.min_by("__row", "__order").alias("__row"))
    return once.unionByName(repeated.select("__row.*"))
