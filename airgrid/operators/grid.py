"""Regular hour grids. A grid holds one row per hour between two times, so a station's series is
bounded by the calendar however many raw readings it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to



def hours_between(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR")))


def hour_grid(df: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """Every hour between each key's first and last time."""
    span = df.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return span.select(key, hours_between(floor_to(F.col("_lo")), floor_to(F.col("_hi"))).alias(time))


def joint_hours(left: DataFrame, right: DataFrame, time: str = "time") -> DataFrame:
    """Every hour of the joint range of two sources."""
    span = (
        left.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        .unionAll(right.agg(F.min(time).alias("lo"), F.max(time).alias("hi")))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return span.select(hours_between(floor_to(F.col("lo")), floor_to(F.col("hi"))).alias(time))


def expose_gaps(df: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """The hourly frame (one row per key and hour) with its missing hours as rows of nulls.

    Each row produces itself and the missing hours up to the next row, so the frame is read once and
    stays partitioned and sorted for the windows that follow.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    following = F.lead(time).over(W.partitionBy(key).orderBy(time))
    rest = [c for c in df.columns if c not in (key, time)]
    spread = df.withColumn("_next", following).select(
        key, F.col(time).alias("_at"), F.explode(F.sequence(F.col(time), F.coalesce(F.col("_next") - hour, F.col(time)), hour)).alias(time), *rest
    )
    return spread.select(*[F.when(F.col(time) == F.col("_at"), F.col(c)).alias(c) if c in rest else F.col(c) for c in df.columns])


def resample_hourly(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), key: str = "station",
    time: str = "time", order: Sequence[str] = (),
) -> DataFrame:
    """Hourly means and first categories (by time, then ``order``) on a gap-free grid."""
    firsts = [F.min_by(c, F.struct(time, *order)).alias(c) for c in categorical]
    hourly = df.groupBy(key, floor_to(F.col(time)).alias("_hour")).agg(
        *[F.avg(c).alias(c) for c in numeric], *firsts
    )
    return expose_gaps(hourly.withColumnRenamed("_hour", time), key, time)


def future_hours(df: DataFrame, steps: int = 24, key: str = "station", time: str = "time") -> DataFrame:
    """The ``steps`` hours after each key's newest time, with their horizon 1..steps."""
    last = df.groupBy(key).agg(F.max(time).alias("_last"))
    ahead = F.posexplode(
        F.sequence(
            F.col("_last") + F.expr("INTERVAL 1 HOUR"), F.col("_last") + F.make_interval(hours=F.lit(steps)),
            F.expr("INTERVAL 1 HOUR"),
        )
    )
    return last.select(key, ahead.alias("_pos", time)).select(key, time, (F.col("_pos") + 1).alias("horizon"))
