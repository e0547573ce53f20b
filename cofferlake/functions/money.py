"""Column helpers for amounts, rates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(x: Column) -> Column:
    """Sum that does not depend on the order of rows: decimals inside, a double outside."""
    return F.coalesce(F.sum(x.cast("decimal(28,6)")).cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def utc(x: Column) -> Column:
    return x.cast("timestamp")
