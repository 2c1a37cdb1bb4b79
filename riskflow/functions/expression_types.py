"""Kinds of values in config expressions, found before anything runs.

Spark would cast a text to a number row by row and fail at the first that is none, or take a
boolean for a number. Here the tree of an expression is gone through once with the types of
the columns it names. A value is a number, a text, a boolean or a date; a literal text may be
what it reads as. What has no known type fits everywhere.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .casts import is_text
from .expressions import COLUMN_PREFIXES, STRUCT_PREFIXES, Resolver, is_date_text, parsed

Kinds = frozenset[str]
TypeOf = Callable[[str, str], T.DataType | None]

ANY: Kinds = frozenset({"number", "text", "boolean", "date"})
_ARITHMETIC = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.FloorDiv, ast.Pow)


def types_in(schema: T.StructType) -> TypeOf:
    """Types of prefixed names by a table's schema."""

    def type_of(prefix: str, name: str) -> T.DataType | None:
        fields = schema
        if prefix in STRUCT_PREFIXES:
            struct = STRUCT_PREFIXES[prefix]
            fields = schema[struct].dataType if struct in schema.names else None
        known = prefix in (*STRUCT_PREFIXES, *COLUMN_PREFIXES) and isinstance(fields, T.StructType)
        return fields[name].dataType if known and name in fields.names else None

    return type_of


def types_of(df: DataFrame, resolve: Resolver) -> TypeOf:
    """Types of prefixed names by the columns they stand for in a table."""

    def type_of(prefix: str, name: str) -> T.DataType | None:
        try:
            return df.select(resolve(prefix, name)).schema.fields[0].dataType
        except AnalysisException:
            # Such as a value that the same calculation is about to add.
            return None

    return type_of


def kinds_of(text: str, type_of: TypeOf) -> Kinds:
    """What an expression may give; raises where it mixes kinds, naming what does not fit."""
    return _Reader(text, type_of).kinds(parsed(text))


def check_kind(text: str, type_of: TypeOf, wanted: str) -> None:
    reader = _Reader(text, type_of)
    reader.require(parsed(text), wanted)


def check_comparison(column: str, text: str, type_of: TypeOf) -> None:
    """Whether a column and an expression can be compared."""
    own, other = _of_type(type_of("ev", column)), kinds_of(text, type_of)
    if not own & other:
        raise ValueError(f"in {text!r}: a {_named(other)} cannot be compared with column {column!r}, a {_named(own)}")


class _Reader:
    def __init__(self, text: str, type_of: TypeOf) -> None:
        self._text, self._type_of = text, type_of

    def require(self, node: ast.expr, wanted: str) -> None:
        kinds = self.kinds(node)
        if wanted not in kinds:
            raise ValueError(f"in {self._text!r}: {_shown(node)} is a {_named(kinds)}, not a {wanted}")

    def kinds(self, node: ast.expr) -> Kinds:
        match node:
            case ast.Constant(value=value):
                return _of_literal(value)
            case ast.Attribute(value=ast.Name(id=prefix), attr=name) if name.startswith("f_"):
                return _of_type(self._type_of(prefix, name[2:]))
            case ast.BinOp(left=left, op=op, right=right) if isinstance(op, _ARITHMETIC):
                if isinstance(op, ast.Sub) and self.kinds(left) == self.kinds(right) == {"date"}:
                    return ANY
                self.require(left, "number")
                self.require(right, "number")
                return frozenset({"number"})
            case ast.BinOp(left=left, right=right):
                self.require(left, "boolean")
                self.require(right, "boolean")
                return frozenset({"boolean"})
            case ast.UnaryOp(op=op, operand=operand):
                kind = "number" if isinstance(op, (ast.USub, ast.UAdd)) else "boolean"
                self.require(operand, kind)
                return frozenset({kind})
            case ast.BoolOp(values=values):
                for value in values:
                    self.require(value, "boolean")
                return frozenset({"boolean"})
            case ast.Compare(left=left, comparators=rights):
                for right in rights:
                    for item in right.elts if isinstance(right, (ast.Tuple, ast.List)) else [right]:
                        self._comparable(left, item)
                    left = right
                return frozenset({"boolean"})
        # Whatever else there is, building the column refuses it.
        return ANY

    def _comparable(self, left: ast.expr, right: ast.expr) -> None:
        a, b = (_of_literal(n.id) if isinstance(n, ast.Name) else self.kinds(n) for n in (left, right))
        if not a & b:
            raise ValueError(
                f"in {self._text!r}: {_shown(left)}, a {_named(a)}, is compared with {_shown(right)}, a {_named(b)}"
            )


def _of_type(data_type: T.DataType | None) -> Kinds:
    if isinstance(data_type, T.NumericType):
        return frozenset({"number"})
    if isinstance(data_type, T.BooleanType):
        return frozenset({"boolean"})
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return frozenset({"date"})
    return frozenset({"text"}) if data_type is not None and is_text(data_type) else ANY


def _of_literal(value: object) -> Kinds:
    if value is None:
        return ANY
    if isinstance(value, bool):
        return frozenset({"boolean"})
    if not isinstance(value, str):
        return frozenset({"number"})
    kinds = {"text"}
    if is_date_text(value):
        kinds.add("date")
    if value.strip().lower() in ("true", "false"):
        kinds.add("boolean")
    try:
        float(value)
        kinds.add("number")
    except ValueError:
        pass
    return frozenset(kinds)


def _named(kinds: Kinds) -> str:
    return " or ".join(sorted(kinds))


def _shown(node: ast.expr) -> str:
    """The part of the expression as it was written."""
    return ast.unparse(node).replace(".f_", ".")
