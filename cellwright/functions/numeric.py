"""Guarded arithmetic: undefined results become 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def safe_ln(x: Column) -> Column:
    """ln(x), 0 where x is not positive."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def round0(c: Column, scale: int) -> Column:
    """Rounded half up; null, NaN and infinite values become 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.round(c, scale))
