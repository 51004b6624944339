"""Duplicate handling. Each operator is one grouped aggregate, so copies combine before the shuffle
and a key that holds a large share of the rows never lands whole in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.rows import non_null_count


def _pick(df: DataFrame, keys: Sequence[str], order: Column, largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    chosen = F.max_by(row, order) if largest else F.min_by(row, order)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, F.struct(*order), largest=False)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, F.struct(*order), largest=True)


def latest_per_key(df: DataFrame, key: str = "station", time: str = "time", tie: Sequence[str] = ()) -> DataFrame:
    """Newest row of each key; ``tie`` columns make equal times deterministic."""
    return _pick(df, [key], F.struct(time, *tie), largest=True)


def keep_most_complete(
    df: DataFrame, keys: Sequence[str], priority: str, counted: Sequence[str] | None = None
) -> DataFrame:
    """Row with the most non-null values per key; the smallest ``priority`` wins a tie."""
    counted = counted or [c for c in df.columns if c not in (*keys, priority)]
    return _pick(df, keys, F.struct(non_null_count(counted), -F.col(priority)), largest=True)


def flag_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Mark every row whose key occurs more than once (null keys compare equal)."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    right = repeated.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_hit"))
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    joined = df.join(right, same, "left")
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False))).select(*df.columns, name)
