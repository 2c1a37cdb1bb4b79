"""riskflow: transaction-monitoring analytics on Spark DataFrames."""

from .config import Calculation, Dataset, DerivedValues, EventTable, FilterRule, ThresholdValue

__all__ = [
    "Calculation",
    "Dataset",
    "DerivedValues",
    "EventTable",
    "FilterRule",
    "ThresholdValue",
]
