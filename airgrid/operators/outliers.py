"""Winsorizing and outlier reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.functions.rows import clip, finite
from airgrid.operators.quantiles import quantile_row
from airgrid.operators.scalars import with_row

# Columns whose lower cap is skipped when the bound is negative.
MAY_BE_NEGATIVE = ("temperature", "wind_direction", "pressure")


def winsorize_global(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, factor: float = 3.0
) -> DataFrame:
    """Cap each column at its own q(low) - f*spread and q(high) + f*spread; quantiles are exact."""
    clean = df.withColumns({c: finite(F.col(c)) for c in columns})
    fenced = with_row(clean, quantile_row(clean, columns, {"lo": low, "hi": high}), "_cuts")
    capped = {}
    for c in columns:
        lo, hi = F.col("_cuts")[f"{c}_lo"], F.col("_cuts")[f"{c}_hi"]
        capped[c] = clip(F.col(c), lo - factor * (hi - lo), hi + factor * (hi - lo))
    return fenced.withColumns(capped).drop("_cuts")


def with_iqr_fences(df: DataFrame, columns: Sequence[str], key: str, factor: float = 1.5) -> DataFrame:
    """Add ``<column>_low`` and ``<column>_high`` of each row's key; the input is an hourly series, so a
    key holds at most one row per hour and ``percentile`` may keep its values."""
    by_key = W.partitionBy(key)
    quart = df.withColumns(
        {f"_q_{c}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(by_key) for c in columns}
    )
    out = {}
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        out |= {f"{c}_low": q1 - factor * (q3 - q1), f"{c}_high": q3 + factor * (q3 - q1)}
    return quart.withColumns(out).drop(*[f"_q_{c}" for c in columns])


def cap_to_fences(column: str) -> Column:
    low, high, value = F.col(f"{column}_low"), F.col(f"{column}_high"), F.col(column)
    skip_low = (low < 0) & F.lit(column in MAY_BE_NEGATIVE)
    return F.when(value > high, high).when((value < low) & ~skip_low, low).otherwise(value)


def winsorize_iqr(df: DataFrame, columns: Sequence[str], key: str = "station", factor: float = 1.5) -> DataFrame:
    fenced = with_iqr_fences(df, columns, key, factor)
    return fenced.withColumns({c: cap_to_fences(c) for c in columns}).select(*df.columns)


def outlier_report(df: DataFrame, columns: Sequence[str], key: str = "station", factor: float = 1.5) -> DataFrame:
    """(key, column, n_outliers, pct, min/max before and after capping) in one aggregate."""
    fenced = with_iqr_fences(df, columns, key, factor)
    aggs = [F.count("*").alias("_n")]
    for c in columns:
        out = (F.col(c) > F.col(f"{c}_high")) | (F.col(c) < F.col(f"{c}_low"))
        after = cap_to_fences(c)
        aggs.append(
            F.struct(
                F.count_if(out).alias("n_outliers"), F.min(c).alias("min_before"), F.max(c).alias("max_before"),
                F.min(after).alias("min_after"), F.max(after).alias("max_after"),
            ).alias(f"_{c}")
        )
    row = fenced.groupBy(key).agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("s")) for c in columns])
    return (
        row.select(key, "_n", F.explode(items).alias("e"))
        .select(key, "e.column", "_n", "e.s.*")
        .withColumn("pct", F.col("n_outliers") * 100.0 / F.col("_n"))
        .drop("_n")
    )


def flag_extreme(df: DataFrame, column: str = "overall_aqi", above: float = 250) -> DataFrame:
    return df.withColumn("is_extreme_event", F.coalesce((F.col(column) > above).cast("int"), F.lit(0)))


def smooth_training_outliers(df: DataFrame, column: str, key: str = "station", time: str = "time") -> DataFrame:
    """Values outside [max(0, min - 2σ), max + 3σ] (σ is the population deviation, bounds from
    ``training_bounds``) become the median of the two neighbours on each side; the first and last row
    of a series become the mean. The bounds columns ``_low``, ``_high``, ``_mean`` must be present."""
    order = W.partitionBy(key).orderBy(time)
    near = F.sort_array(F.collect_list(column).over(order.rowsBetween(-2, 2)))
    half = F.floor(F.size(near) / 2).cast("int")
    median = F.when(F.size(near) % 2 == 1, F.element_at(near, half + 1)).otherwise(
        (F.element_at(near, half) + F.element_at(near, half + 1)) / 2
    )
    edge = F.lag(column).over(order).isNull() | F.lead(column).over(order).isNull()
    outside = (F.col(column) > F.col("_high")) | (F.col(column) < F.col("_low"))
    fixed = F.when(outside & edge, F.col("_mean")).when(outside, median).otherwise(F.col(column))
    return df.withColumn(column, fixed).drop("_low", "_high", "_mean")


def training_bounds(train: DataFrame, column: str, key: str = "station") -> DataFrame:
    sd = F.stddev_pop(column)
    return train.groupBy(key).agg(
        F.greatest(F.lit(0.0), F.min(column) - 2 * sd).alias("_low"),
        (F.max(column) + 3 * sd).alias("_high"),
        F.avg(column).alias("_mean"),
    )


def clean_training_series(
    df: DataFrame, train: DataFrame, column: str, key: str = "station", time: str = "time"
) -> DataFrame:
    return smooth_training_outliers(df.join(training_bounds(train, column, key), key), column, key, time)
