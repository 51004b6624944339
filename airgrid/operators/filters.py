"""Row and column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.clock import local_to_utc
from airgrid.operators.scalars import with_row


def max_time(df: DataFrame, time: str = "time") -> Column:
    return df.agg(F.max(time).alias("m")).scalar()


def historical(
    df: DataFrame, days: int, stations: Sequence[str] | None = None, as_of: Column | None = None,
    time: str = "time", station: str = "station",
) -> DataFrame:
    """Rows of the ``days`` before ``as_of`` (default: the newest row), optionally of some stations."""
    end = max_time(df, time) if as_of is None else as_of
    kept = df.where(F.col(time).between(end - F.make_interval(days=F.lit(days)), end))
    return kept.where(F.col(station).isin(*stations)) if stations else kept


def last_days(df: DataFrame, days: int, as_of: Column | None = None, time: str = "time") -> DataFrame:
    """Rows strictly newer than ``as_of`` minus ``days``."""
    end = max_time(df, time) if as_of is None else as_of
    return df.where(F.col(time) > end - F.make_interval(days=F.lit(days)))


def incremental_bounds(merged: DataFrame, time: str = "time") -> dict[str, Column]:
    """Lower bounds of an incremental run from the newest merged hour.

    Readings overlap by one hour, weather reaches 24 h further back so that gaps can be interpolated,
    and the UTC source one hour further back, in UTC. All are null when nothing is merged yet.
    """
    readings = max_time(merged, time) - F.expr("INTERVAL 1 HOUR")
    return {
        "readings": readings,
        "weather": readings - F.expr("INTERVAL 24 HOURS"),
        "utc": local_to_utc(readings) - F.expr("INTERVAL 1 HOUR"),
    }


def newer_than(df: DataFrame, bound: Column, time: str = "time") -> DataFrame:
    """``time > bound``; a null bound keeps everything."""
    return df.where(F.col(time) > F.coalesce(bound, F.lit("0001-01-01").cast("timestamp_ntz")))


def valid_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def rejected_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows ``valid_rows`` leaves out, with the names of the columns that failed."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("failed", F.array_join(reasons, ",")).where(F.col("failed") != "")


def null_shares(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    shares = [F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*shares)


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Drop the columns that are null in more than ``limit`` of the rows (one aggregate row is read)."""
    shares = null_shares(df, columns).first().asDict()
    return df.drop(*[c for c in columns if shares[c] is not None and shares[c] > limit])


def busiest(df: DataFrame, n: int, key: str = "station") -> DataFrame:
    """Rows of the ``n`` keys with the most rows (ties by name). The semi join's right side has n rows."""
    top = df.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def distinct_text(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a categorical column as one comma-separated text."""
    values = df.select(column).distinct()
    return values.agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(name))


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every column of a one-row frame next to every row."""
    return with_row(df, stats).withColumns({c: F.col("_row")[c] for c in stats.columns}).drop("_row")
