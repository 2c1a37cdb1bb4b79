"""Every operator as a query over the test tables, with the same query in SQL."""

from . import aggregates, columns, filters, joins, lists, python_functions, sources, workflows  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
