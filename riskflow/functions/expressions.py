"""Columns from the expressions written in rule configs.

A config is data, so nothing is evaluated as code: Python's own ``ast`` reads the
text and a short list of node kinds is mapped onto column operators. Calls,
subscripts, attribute chains and everything else raise ``ValueError``.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Collection
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .casts import is_text
from .columns import quoted
from .structs import field

# Prefixes of names in expressions and the struct each one reads;
# ``ev`` and ``ds`` name plain columns.
STRUCT_PREFIXES = {
    "derived": "derived_values",
    "dth": "dynamic_thresholds",
    "th": "static_thresholds",
}
COLUMN_PREFIXES = ("ev", "ds")

Resolver = Callable[[str, str], Column]

_PREFIXES = "|".join((*STRUCT_PREFIXES, *COLUMN_PREFIXES))
_DATE_TEXT = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"
_DATE = re.compile(_DATE_TEXT)
_PATH = re.compile(
    rf"""('[^']*'|"[^"]*")|\b({_PREFIXES})\.([A-Za-z_]\w*)|(?<![\w.])({_DATE_TEXT})(?![\w.])"""
)
_WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


def _floor_divide(a: Column, b: Column) -> Column:
    """Python's ``//`` as a whole number; that of whole numbers does not go through double."""
    b = F.nullif(b, F.lit(0))
    x, y = a.cast("bigint"), b.cast("bigint")
    rounded_up = (x % y != 0) & ((x < 0) != (y < 0))
    exact = F.call_function("div", x, y) - F.when(rounded_up, 1).otherwise(0)
    whole = F.typeof(a).isin(*_WHOLE_TYPES) & F.typeof(b).isin(*_WHOLE_TYPES)
    return F.when(whole, exact).otherwise(F.floor(a / b))


_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    # Division by zero gives null: a threshold that cannot be computed is unknown.
    ast.Div: lambda a, b: a / F.nullif(b, F.lit(0)),
    ast.Mod: lambda a, b: a % F.nullif(b, F.lit(0)),
    ast.FloorDiv: _floor_divide,
    ast.Pow: F.pow,
    ast.BitAnd: operator.and_,
    ast.BitOr: operator.or_,
}
_UNARY = {ast.USub: operator.neg, ast.UAdd: lambda a: a, ast.Not: operator.invert, ast.Invert: operator.invert}
_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}


def column_resolver(dataset_columns: Collection[str] | None = None) -> Resolver:
    """Resolve prefixed names against the structs and columns of the table.

    With ``dataset_columns`` given, ``ds`` may only name one of them.
    """

    def resolve(prefix: str, name: str) -> Column:
        if prefix in STRUCT_PREFIXES:
            return field(STRUCT_PREFIXES[prefix], name)
        if prefix == "ds" and dataset_columns is not None and name not in dataset_columns:
            raise ValueError(f"the dataset has no column {name!r}")
        return quoted(name)

    return resolve


def config_column(text: str, resolve: Resolver | None = None) -> Column:
    """Column for an expression such as ``derived.mean + 3 * derived.std``."""
    return _column(parsed(text), resolve or column_resolver(), text)


def parsed(text: str) -> ast.expr:
    """The expression as a tree, in which names after a prefix start with ``f_``."""
    source = text.strip()
    if source.lower() in ("true", "false"):
        return ast.Constant(source.lower() == "true")
    if _DATE.fullmatch(source):
        return ast.Constant(source)
    # Any field name is allowed after a prefix, also words Python keeps for itself. A date
    # outside quotes is a date, not a subtraction.
    marked = _PATH.sub(lambda m: m[1] or (f"'{m[4]}'" if m[4] else f"{m[2]}.f_{m[3]}"), source)
    try:
        return ast.parse(marked, mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"cannot read expression {text!r}") from error


def _column(node: ast.expr, resolve: Resolver, text: str) -> Column:
    def build(child: ast.expr) -> Column:
        return _column(child, resolve, text)

    match node:
        case ast.Constant(value=bool() | int() | float() | str() | None):
            return F.lit(node.value)
        case ast.Attribute(value=ast.Name(id=prefix), attr=name) if name.startswith("f_"):
            return resolve(prefix, name[2:])
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](build(left), build(right))
        case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
            return _UNARY[type(op)](build(operand))
        case ast.BoolOp(op=op, values=values):
            join = operator.and_ if isinstance(op, ast.And) else operator.or_
            result = build(values[0])
            for value in values[1:]:
                result = join(result, build(value))
            return result
        case ast.Compare(left=left, ops=ops, comparators=rights):
            result = None
            for op, right in zip(ops, rights):
                part = _compare(left, op, right, build, text)
                result = part if result is None else result & part
                left = right
            return result
    raise ValueError(f"not allowed in expression {text!r}: {ast.unparse(node)}")


def _compare(left: ast.expr, op: ast.cmpop, right: ast.expr, build: Any, text: str) -> Column:
    def side(node: ast.expr) -> Column:
        # A bare word next to a comparison is text: ev.status == Active
        return F.lit(node.id) if isinstance(node, ast.Name) else build(node)

    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.Tuple, ast.List)):
        found = side(left).isin([side(item) for item in right.elts])
        return ~found if isinstance(op, ast.NotIn) else found
    if type(op) not in _COMPARE:
        raise ValueError(f"comparison not allowed in expression {text!r}")
    return _COMPARE[type(op)](side(left), side(right))


def is_date_text(text: str) -> bool:
    return _DATE.fullmatch(text.strip()) is not None


def has_path(text: str) -> bool:
    """Whether the text names a prefixed column outside quotes."""
    return any(m[2] for m in _PATH.finditer(text))


def literal_for(value: Any, data_type: T.DataType) -> Column:
    """Literal to compare with a column of this type.

    Config values are text. They are read as the column's own kind of value so that
    the comparison needs no cast on the column and reaches the file scan.
    """
    if not isinstance(value, str):
        if is_text(data_type):
            return F.lit(str(value))
        if isinstance(data_type, T.DecimalType):
            return F.lit(Decimal(str(value)))
        return F.lit(value).cast(data_type) if isinstance(data_type, T.FloatType) else F.lit(value)
    text = value.strip()
    if is_text(data_type):
        return F.lit(_unquoted(value))
    if isinstance(data_type, T.BooleanType):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"not a boolean: {value!r}")
        return F.lit(text.lower() == "true")
    if isinstance(data_type, T.NumericType):
        text = _unquoted(text)
        try:
            if isinstance(data_type, T.DecimalType):
                return F.lit(Decimal(text))
            number = F.lit(_number(text))
            return number.cast(data_type) if isinstance(data_type, T.FloatType) else number
        except (ValueError, SyntaxError, ArithmeticError):
            return config_column(text)
    return F.lit(_unquoted(text)).cast(data_type)


def parse_sequence(value: Any) -> list[Any]:
    """Items of a list given as values or as text such as ``(1, 5)`` or ``[a, b]``."""
    if not isinstance(value, str):
        return list(value) if isinstance(value, (list, tuple, set)) else [value]
    try:
        parsed = ast.literal_eval(value.strip())
        return list(parsed) if isinstance(parsed, (list, tuple, set)) else [parsed]
    except (ValueError, SyntaxError):
        inner = value.strip()
        if inner[:1] in "([{" and inner[-1:] in ")]}":
            inner = inner[1:-1]
        return [_unquoted(item.strip()) for item in inner.split(",") if item.strip()]


def _unquoted(text: str) -> str:
    stripped = text.strip()
    if len(stripped) > 1 and stripped[0] == stripped[-1] and stripped[0] in "'\"":
        return stripped[1:-1]
    return text


def _number(text: str) -> int | float:
    number = ast.literal_eval(text)
    if isinstance(number, bool) or not isinstance(number, (int, float)):
        raise ValueError(text)
    return number
