"""Time-bucketed aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to

UNITS = {"1 hour": "hour", "1 day": "day", "1 week": "week", "1 month": "month", "1 minute": "minute"}


def bucket(time: Column | str, interval: str) -> Column:
    """Start of the bucket. Calendar units truncate; other widths use Spark's epoch-aligned windows."""
    time = F.col(time) if isinstance(time, str) else time
    if interval in UNITS:
        return floor_to(time, UNITS[interval])
    return F.window(time, interval).getField("start")


def time_bucket(
    df: DataFrame, interval: str, aggregates: Sequence[str | Column], keys: Sequence[str] = (),
    time: str = "time", where: str | Column | None = None, name: str = "bucket",
) -> DataFrame:
    """Group by bucket and keys; aggregates may be SQL texts (``avg(value) AS mean``) or Columns."""
    rows = df if where is None else df.where(where)
    exprs = [F.expr(a) if isinstance(a, str) else a for a in aggregates]
    return rows.groupBy(bucket(time, interval).alias(name), *keys).agg(*exprs)


def by_hour_of_day(df: DataFrame, value: str, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    return df.groupBy(*keys, F.hour(time).alias("hour")).agg(F.avg(value).alias("mean_value"))


def by_weekday(df: DataFrame, value: str, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    return df.groupBy(*keys, F.weekday(time).alias("day_of_week")).agg(F.avg(value).alias("mean_value"))


def hourly_weather(
    df: DataFrame, numeric: Sequence[str], icon: str, keys: Sequence[str] = ("station",), time: str = "time",
) -> DataFrame:
    """Hourly means plus the most common icon (smallest among ties); icons are a small vocabulary."""
    return df.groupBy(floor_to(F.col(time)).alias("time"), *keys).agg(
        *[F.avg(c).alias(c) for c in numeric], F.mode(icon, True).alias(icon)
    )
