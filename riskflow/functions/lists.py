"""Lists kept as separated text: containment, pair lists, set difference.

All of it is array expressions of Spark SQL, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def literal_pattern(text: str) -> str:
    """A Java regular expression that matches exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_list(column: Column | str, separator: str = ",") -> Column:
    """Split at a separator taken literally, not as a pattern."""
    return F.split(as_column(column), literal_pattern(separator))


def trimmed(item: Column) -> Column:
    """Without white space at both ends, tabs and line breaks included."""
    return F.btrim(item, F.lit(" \t\n\x0b\f\r"))


def list_items(
    column: Column | str, separator: str = ",", trim: bool = True, drop_blank: bool = True
) -> Column:
    """Items of separated text, trimmed and without blanks unless told otherwise."""
    items = split_list(column, separator)
    if trim:
        items = F.transform(items, trimmed)
    if drop_blank:
        items = F.filter(items, lambda item: item != "")
    return items


def all_contained(items: Column, container: Column) -> Column:
    """True where every item is in the container; null where either list is null."""
    return F.size(F.array_except(items, container)) == 0


def list_in(
    column1: Column | str,
    column2: Column | str | Sequence[str],
    separator: str = ",",
    trim: bool = True,
    drop_blank: bool = True,
) -> Column:
    """True where every item of ``column2`` is an item of ``column1``.

    ``column2`` is a column of separated text, one text for all rows, or a list.
    """
    container = list_items(column1, separator, trim, drop_blank)
    if isinstance(column2, Column):
        wanted = list_items(column2, separator, trim, drop_blank)
    elif isinstance(column2, str):
        wanted = list_items(F.lit(column2), separator, trim, drop_blank)
    else:
        texts = [F.lit(str(item)) for item in column2]
        wanted = F.array(*[trimmed(t) if trim else t for t in texts]).cast("array<string>")
    return all_contained(wanted, container)


def sorted_pair(pair: Column, delimiter: str = "/") -> Column:
    """The pair with its parts in order, so that A/B and B/A are the same text."""
    return F.array_join(F.array_sort(split_list(pair, delimiter)), delimiter)


def pair_items(
    column: Column | str, separator: str = ",", delimiter: str = "/", strip: bool = False
) -> Column:
    """List of order-free pairs, optionally with whitespace stripped first."""
    text = as_column(column)
    if strip:
        text = F.regexp_replace(text, r"\s+", "")
    return F.transform(split_list(text, separator), lambda pair: sorted_pair(pair, delimiter))


def list_not_in_list(
    expr1: Column | str,
    expr2: Column | str,
    separator: str = ",",
    delimiter: str = "/",
    strip: bool = False,
) -> Column:
    """True where some pair of ``expr1`` is missing from ``expr2``.

    Repeats and the order inside a pair do not matter. A string ``expr2`` is one
    literal list for all rows; ``strip`` removes whitespace from both sides.
    """
    if not isinstance(expr2, (Column, str)):
        raise ValueError("expr2 must be a column or text")
    other = expr2 if isinstance(expr2, Column) else F.lit(expr2)
    mine = pair_items(expr1, separator, delimiter, strip)
    return ~all_contained(mine, pair_items(other, separator, delimiter, strip))


def normalize_pair_list(
    column: Column | str,
    separator: str = ",",
    pair_delimiter: str = "/",
    more_separators: Sequence[str] = (),
) -> Column:
    """Whitespace removed, split at any of the separators, each pair put in order."""
    pattern = "|".join(literal_pattern(s) for s in (separator, *more_separators))
    text = F.regexp_replace(as_column(column), r"\s+", "")
    return F.transform(F.split(text, pattern), lambda pair: sorted_pair(pair, pair_delimiter))


def map_items(column: Column | str, function: Callable[[Column], Column]) -> Column:
    """Apply a column function to every item of an array."""
    return F.transform(as_column(column), function)


def items_missing_from(column: Column | str, other: Column | str) -> Column:
    """Distinct items of one array that the other lacks."""
    return F.array_except(as_column(column), as_column(other))


def all_true(column: Column | str) -> Column:
    """True where no item of a boolean array is false."""
    return F.forall(as_column(column), lambda item: item)
