"""Three-valued logic.

Per row SQL's ``AND``/``OR`` already are Kleene's. Over groups ``bool_and`` and
``bool_or`` skip nulls, so the two aggregates below put the unknowns back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_known_true(met: Column) -> Column:
    """False if any is false, else null if any is unknown, else true."""
    return (
        F.when(F.bool_or(~met), F.lit(False))
        .when(F.count_if(met.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True))
    )


def any_known_true(met: Column) -> Column:
    """True if any is true, else null if any is unknown, else false."""
    return (
        F.when(F.bool_or(met), F.lit(True))
        .when(F.count_if(met.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def compare(operator: Column, value: Column, threshold: Column) -> Column:
    """The comparison named by the operator column; null for an unknown name."""
    return (
        F.when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "=", value == threshold)
    )
