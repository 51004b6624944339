"""Lag, rolling and split features on hourly series.

All functions use the same partitioning and order, so a chain of them costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(key: str = "station", time: str = "time"):
    return W.partitionBy(key).orderBy(time)


def lags(column: str, steps: Sequence[int], key: str = "station", time: str = "time", suffix: str = "h") -> dict[str, Column]:
    w = series(key, time)
    return {f"{column}_lag_{k}{suffix}": F.lag(column, k).over(w) for k in steps}


def diffs(
    column: str, steps: Sequence[int], key: str = "station", time: str = "time", shifted: bool = False
) -> dict[str, Column]:
    """x[t] - x[t-k]; ``shifted`` moves it back one row (x[t-1] - x[t-1-k]) so it cannot reveal x[t]."""
    w = series(key, time)
    s = 1 if shifted else 0
    now = F.lag(column, 1).over(w) if shifted else F.col(column)
    return {f"{column}_diff_{k}h": now - F.lag(column, k + s).over(w) for k in steps}


_ROLL = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling(
    column: str, widths: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max"),
    key: str = "station", time: str = "time", include_current: bool = False,
) -> dict[str, Column]:
    """Statistics of the last ``width`` rows; null until the window is full of known values."""
    w = series(key, time)
    out: dict[str, Column] = {}
    for width in widths:
        frame = w.rowsBetween(1 - width, 0) if include_current else w.rowsBetween(-width, -1)
        full = F.count(column).over(frame) == width
        for stat in stats:
            out[f"{column}_rolling_{stat}_{width}h"] = F.when(full, _ROLL[stat](column).over(frame))
    return out


def profile_means(column: str, key: str = "station", time: str = "time") -> dict[str, Column]:
    """The key's mean by hour of day and by weekday, next to each hourly row."""
    return {
        f"{column}_hour_avg": F.avg(column).over(W.partitionBy(key, F.hour(time))),
        f"{column}_dow_avg": F.avg(column).over(W.partitionBy(key, F.weekday(time))),
    }


def running_profiles(column: str, key: str = "station", time: str = "time") -> dict[str, Column]:
    """As ``profile_means``, over the earlier rows only, so that nothing of the current value is in them. A recursive forecast
    carries the same sums on."""
    before = lambda part: W.partitionBy(key, part).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    return {f"{column}_hour_avg": F.avg(column).over(before(F.hour(time))), f"{column}_dow_avg": F.avg(column).over(before(F.weekday(time)))}


def direction(column: str, key: str = "station", time: str = "time") -> Column:
    return F.signum(F.col(column) - F.lag(column).over(series(key, time)))


def skip_first(df: DataFrame, n: int, key: str = "station", time: str = "time") -> DataFrame:
    """Leave out the first ``n`` rows of each series (they lack lag history); shorter series vanish."""
    ranked = df.withColumn("_rn", F.row_number().over(series(key, time)))
    return ranked.where(F.col("_rn") > n).drop("_rn")


def last_rows(df: DataFrame, n: int, key: str = "station", time: str = "time") -> DataFrame:
    """Newest ``n`` rows per key; Spark limits each partition before the shuffle."""
    newest = W.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def split_per_key(df: DataFrame, share: float = 0.8, key: str = "station", time: str = "time") -> DataFrame:
    """Add ``is_train``: the first int(n*share) rows of each series."""
    rn = F.row_number().over(series(key, time))
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn("is_train", rn <= F.floor(n * F.lit(share)))


def split_at_time(df: DataFrame, share: float = 0.8, time: str = "time") -> DataFrame:
    """Add ``is_train`` with one time cut for all keys: the latest hour that keeps the training rows
    within int(n*share). Only the per-hour counts are ordered globally."""
    per_hour = df.groupBy(time).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.orderBy(time).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_n").over(W.partitionBy(F.lit(0)))
    cut = (
        per_hour.select(time, upto.alias("_upto"), total.alias("_total"))
        .where(F.col("_upto") <= F.floor(F.col("_total") * F.lit(share)))
        .agg(F.max(time).alias("cut"))
        .scalar()
    )
    return df.withColumn("is_train", F.coalesce(F.col(time) <= cut, F.lit(False)))


def expanding_folds(df: DataFrame, folds: int = 5, time: str = "time", key: str = "station") -> DataFrame:
    """Add ``fold``: 0 for rows only ever trained on, i for the rows of test block i.

    Rows are in (time, key) order, a test block has n // (folds + 1) rows, and fold i trains on all
    rows of a smaller fold number. Positions come from per-hour counts plus the place in the hour.
    """
    per_hour = df.groupBy(time).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(time).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_hour.select(time, before.alias("_before"))
    joined = df.join(offsets, time).withColumn("_total", df.agg(F.count("*").alias("n")).scalar())
    total = F.col("_total")
    size = F.floor(total / F.lit(folds + 1))
    position = F.col("_before") + F.row_number().over(W.partitionBy(time).orderBy(key)) - 1
    start = total - size * F.lit(folds)
    fold = F.when(position < start, F.lit(0)).otherwise(F.floor((position - start) / size) + 1)
    return joined.withColumn("fold", fold.cast("int")).drop("_before", "_total")
