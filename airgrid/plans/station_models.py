"""Models of single stations as rows of a table: fitted by one grouped job, stored by station, reloaded and joined for scoring.

A row is ``station, kind, features, n, intercept, coefficients, stumps``. A linear model has coefficients; a boosted one has
stumps (the place of a feature, a threshold, what is added at or below it and above it). Scoring is a join and an expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.operators.dedup import keep_last
from airgrid.plans.training import grouped_least_squares
from airgrid.sources import snapshots

STUMPS = "ARRAY<STRUCT<feature: INT, threshold: DOUBLE, low: DOUBLE, high: DOUBLE>>"
KEYS = ["station", "kind"]


def _as_rows(models: DataFrame, kind: str, features: Sequence[str]) -> DataFrame:
    return models.select(
        "station", F.lit(kind).alias("kind"), F.array(*[F.lit(f) for f in features]).alias("features"), F.col("n").cast("long").alias("n"), "intercept", "coefficients", "stumps"
    )


def fit_linear(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0) -> DataFrame:
    """A linear model per station from its sums; rows with a null feature or label do not count."""
    models = grouped_least_squares(df, features, label, "station", alpha)
    return _as_rows(models.withColumn("stumps", F.lit(None).cast(STUMPS)), "linear", features)


def best_stump(x: np.ndarray, order: np.ndarray, residual: np.ndarray) -> tuple[int, float, float, float] | None:
    """The split of least squared error over all features: (feature, threshold, mean at or below, mean above).

    ``order`` sorts each column of ``x``. Ties go to the earlier feature, then to the smaller threshold; None if nothing splits.
    """
    n, total = len(residual), residual.sum()
    best, found = 0.0, None
    for f in range(x.shape[1]):
        values = x[order[:, f], f]
        sums, left = np.cumsum(residual[order[:, f]])[:-1], np.arange(1, n)
        gain = np.where(values[:-1] < values[1:], sums**2 / left + (total - sums) ** 2 / (n - left) - total**2 / n, -1.0)
        if len(gain) and (at := int(np.argmax(gain))) >= 0 and gain[at] > best * (1 + 1e-12) + 1e-12:
            best, found = gain[at], (f, float(values[at]), float(sums[at] / left[at]), float((total - sums[at]) / (n - left[at])))
    return found


def _boost(features: list[str], label: str, rounds: int, rate: float, rows: pd.DataFrame) -> pd.DataFrame:
    x, y = rows[features].to_numpy("float64"), rows[label].to_numpy("float64")
    order = np.argsort(x, axis=0, kind="stable")
    start = y.mean()
    residual, stumps = y - start, []
    for _ in range(rounds):
        found = best_stump(x, order, residual)
        if found is None:
            break
        f, threshold, low, high = found
        stumps.append({"feature": f, "threshold": threshold, "low": rate * low, "high": rate * high})
        residual = residual - np.where(x[:, f] <= threshold, rate * low, rate * high)
    return pd.DataFrame({"station": [rows["station"].iloc[0]], "n": [len(rows)], "intercept": [start], "stumps": [stumps]})


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 50, rate: float = 0.1) -> DataFrame:
    """Boosted stumps per station, all stations in one job. A station's hourly training rows (bounded by the calendar) meet in one
    task as numbers; rows with a null feature or label do not count."""
    known = df.select("station", *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label)).na.drop("any")
    models = known.groupBy("station").applyInPandas(partial(_boost, list(features), label, rounds, rate), f"station STRING, n LONG, intercept DOUBLE, stumps {STUMPS}")
    return _as_rows(models.withColumn("coefficients", F.lit(None).cast("array<double>")), "boosted", features)


def score(df: DataFrame, models: DataFrame, features: Sequence[str], kind: str, least: float | None = 0.0) -> DataFrame:
    """Rows with the ``prediction`` of their station's model; null where it has none or a feature is null. Models whose features
    differ from ``features`` are no models of this frame."""
    own = models.where((F.col("kind") == kind) & (F.col("features") == F.array(*[F.lit(f) for f in features]))).select("station", "intercept", "coefficients", "stumps")
    x = F.array(*[F.col(f).cast("double") for f in features])
    if kind == "linear":
        value: Column = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    else:
        value = F.aggregate("stumps", F.col("intercept"), lambda s, t: s + F.when(F.get(x, t["feature"]) <= t["threshold"], t["low"]).when(F.get(x, t["feature"]) > t["threshold"], t["high"]))
    joined = df.join(own, "station", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (value if least is None else F.when(value.isNotNull(), F.greatest(value, F.lit(least)))).alias("prediction"))


def store(models: DataFrame, path: str) -> None:
    """Adds the models to the table at ``path``; a model of the same station and kind is replaced. Published at once (see ``snapshots``)."""

    def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        both = rows.withColumn("_rank", F.lit(1))
        if old is not None:
            both = old.withColumn("_rank", F.lit(0)).unionByName(both)
        return keep_last(both, KEYS, ["_rank"]).drop("_rank")

    snapshots.merge(models.withColumns({"features": F.to_json("features"), "coefficients": F.to_json("coefficients"), "stumps": F.to_json("stumps")}), path, combine, KEYS, None)


def load(spark: SparkSession, path: str, stations: Sequence[str] | None = None) -> DataFrame:
    """The stored models, or those of some stations."""
    table = snapshots.read(spark, path)
    if stations is not None:
        table = table.where(F.col("station").isin(list(stations)))
    return table.withColumns({"features": F.from_json("features", "ARRAY<STRING>"), "coefficients": F.from_json("coefficients", "ARRAY<DOUBLE>"), "stumps": F.from_json("stumps", STUMPS)})
