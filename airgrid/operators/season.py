"""Seasonal decomposition, autocorrelation and a unit-root statistic per series."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.operators.lagging import series


def decompose(df: DataFrame, column: str, period: int = 24, key: str = "station", time: str = "time") -> DataFrame:
    """Additive decomposition of a gap-free series: adds ``<column>_trend``, ``_seasonal``, ``_resid``.

    Trend is the centred moving average with half weights at both ends (even periods), seasonal the
    mean detrended value of each phase, centred to sum to zero.
    """
    w = series(key, time)
    half = period // 2
    inner = w.rowsBetween(1 - half, half - 1) if period % 2 == 0 else w.rowsBetween(-half, half)
    if period % 2 == 0:
        ends = (F.lag(column, half).over(w) + F.lead(column, half).over(w)) / 2
        complete = F.count(column).over(w.rowsBetween(-half, half)) == period + 1
        trend = F.when(complete, (F.sum(column).over(inner) + ends) / period)
    else:
        trend = F.when(F.count(column).over(inner) == period, F.sum(column).over(inner) / period)
    t, s, r = f"{column}_trend", f"{column}_seasonal", f"{column}_resid"
    framed = df.withColumn(t, trend).withColumn("_phase", (F.row_number().over(w) - 1) % period)
    phases = framed.groupBy(key, "_phase").agg(F.avg(F.col(column) - F.col(t)).alias("_p"))
    centred = phases.withColumn(s, F.col("_p") - F.avg("_p").over(W.partitionBy(key))).select(key, "_phase", s)
    out = framed.join(centred, [key, "_phase"], "left")
    return out.withColumn(r, F.col(column) - F.col(t) - F.col(s)).drop("_phase")


def autocovariances(df: DataFrame, column: str, lags: int, key: str = "station", time: str = "time") -> DataFrame:
    """One row per key with the array ``acf`` of length lags + 1."""
    centred = df.withColumn("_c", F.col(column) - F.avg(column).over(W.partitionBy(key)))
    w = series(key, time)
    products = {f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)}
    sums = centred.withColumns({"_p0": F.col("_c") * F.col("_c")} | products)
    totals = sums.groupBy(key).agg(*[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(lags + 1)])
    return totals.select(key, F.array(*[F.col(f"_p{k}") / F.col("_p0") for k in range(lags + 1)]).alias("acf"))


def acf(df: DataFrame, column: str, lags: int = 48, key: str = "station", time: str = "time") -> DataFrame:
    """(key, lag, acf)."""
    rows = autocovariances(df, column, lags, key, time)
    return rows.select(key, F.posexplode("acf").alias("lag", "acf"))


def _levinson(rho: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations by the Durbin-Levinson recursion."""
    out = np.ones(len(rho))
    phi = np.zeros(0)
    for k in range(1, len(rho)):
        top = rho[k] - phi @ rho[k - 1 : 0 : -1] if k > 1 else rho[1]
        bottom = 1.0 - phi @ rho[1:k] if k > 1 else 1.0
        out[k] = top / bottom
        phi = np.append(phi - out[k] * phi[::-1], out[k])
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def partials(rho: pd.Series) -> pd.Series:
    return rho.map(lambda r: _levinson(np.asarray(r, dtype=float)).tolist())


def pacf(df: DataFrame, column: str, lags: int = 48, key: str = "station", time: str = "time") -> DataFrame:
    """(key, lag, pacf); the recursion runs on lags + 1 numbers per key."""
    rows = autocovariances(df, column, lags, key, time).select(key, partials("acf").alias("pacf"))
    return rows.select(key, F.posexplode("pacf").alias("lag", "pacf"))


def unit_root(
    df: DataFrame, column: str, key: str = "station", time: str = "time", critical: float = -2.862
) -> DataFrame:
    """Dickey-Fuller statistic with intercept: t-value of x[t-1] in x[t]-x[t-1] = a + b x[t-1].

    ``critical`` is the usual 5 % point for long series; below it the series counts as stationary.
    """
    w = series(key, time)
    steps = df.select(key, F.lag(column).over(w).alias("_x"), (F.col(column) - F.lag(column).over(w)).alias("_y"))
    sums = steps.groupBy(key).agg(
        F.regr_count("_y", "_x").alias("n"), F.regr_slope("_y", "_x").alias("slope"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    error = F.sqrt((F.col("_syy") - F.col("slope") * F.col("_sxy")) / (F.col("n") - 2) / F.col("_sxx"))
    return sums.withColumn("t_stat", F.col("slope") / error).select(
        key, "n", "slope", "t_stat", (F.col("t_stat") < critical).alias("is_stationary")
    )


def differencing_order(stats: DataFrame) -> DataFrame:
    return stats.withColumn("d", F.when(F.col("is_stationary"), 0).otherwise(1))


