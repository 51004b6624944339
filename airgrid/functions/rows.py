"""Row-level helpers used across the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_null_count(columns: Iterable[str]) -> Column:
    return reduce(add, [F.col(f"`{c}`").isNotNull().cast("int") for c in columns])


def null_count(columns: Iterable[str]) -> Column:
    return reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in columns])


def finite(value: Column) -> Column:
    """±infinity and NaN become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def clip(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a value; a null stays null (``least``/``greatest`` alone would return the bound)."""
    bounded = value
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(float(high)))
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(float(low)))
    return F.when(value.isNotNull(), bounded)


def min_max(value: Column, low: Column, high: Column, inverse: bool = False) -> Column:
    """Scale to 0..1 (or 1..0); a constant column gives 1."""
    share = F.when(high == low, F.lit(0.0 if inverse else 1.0)).otherwise((value - low) / (high - low))
    share = clip(share, 0.0, 1.0)
    return F.lit(1.0) - share if inverse else share


def gauge(value: Column, low: float, high: float) -> Column:
    return (clip(value, low, high) - F.lit(float(low))) / F.lit(float(high - low))
