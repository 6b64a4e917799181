"""Column functions with the same results in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: str, scale: int = 2) -> Column:
    """Doubles as decimals, so that sums don't depend on the order of addition."""
    return F.col(column).cast(f"decimal(18,{scale})")


def hour_of(column: str) -> Column:
    return F.date_trunc("hour", F.col(column)).cast("timestamp_ntz")


def fraction(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded; null if whole is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)
