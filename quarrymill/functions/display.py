"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def percent(x: Column) -> Column:
    """One decimal, half up, for non-negative values."""
    tenths = F.round(x * 10).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def billions(x: Column, unit: str = "bn") -> Column:
    return F.concat(F.format_number(x / 1e9, 2), F.lit(f" {unit}"))
