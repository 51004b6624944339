"""Joins and source merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.rows import null_count



def with_city_weather(readings: DataFrame, weather: DataFrame, time: str = "time") -> DataFrame:
    """Give every station the city-wide weather of its hour.

    ``weather`` has one row per hour, so it is bounded by the calendar, not by the data. The join is
    left to Catalyst: below the broadcast threshold it broadcasts, beyond it AQE picks a shuffle join.
    """
    return readings.join(weather, time, "left")


def with_station_weather(grid: DataFrame, weather: DataFrame, keys: Sequence[str] = ("time", "station")) -> DataFrame:
    return grid.join(weather, list(keys), "left")


def outer_on_time(left: DataFrame, right: DataFrame, time: str = "time") -> DataFrame:
    return left.join(right, time, "full")


def join_listed_places(left: DataFrame, right: DataFrame, time: str, place: str, listed: str) -> DataFrame:
    """``right[listed]`` is a comma list of places; join each on (time, place).

    When no row meets at all the result is the full outer join on time, as one plan: the fallback
    branch is switched on by a scalar subquery.
    """
    single = right.withColumn(place, F.explode(F.split(listed, ","))).withColumn(place, F.trim(place)).drop(listed)
    matched = left.join(single, [time, place], "inner")
    nothing = matched.agg((F.count("*") == 0).alias("empty")).scalar()
    fallback = outer_on_time(left, right.drop(listed), time).where(nothing)
    return matched.unionByName(fallback, allowMissingColumns=True)


def only_new(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored; a null in the key never matches, so such rows are always new.

    Keys are de-duplicated first, on the partitioning the join needs anyway.
    """
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def already_stored(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_semi")


def record_exists(stored: DataFrame, **key: object) -> bool:
    """Whether a row with these column values exists; reads until the first hit."""
    test = stored
    for column, value in key.items():
        test = test.where(F.col(column).eqNullSafe(F.lit(value)))
    return not test.select(F.lit(1)).limit(1).isEmpty()


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fold ``new`` into ``old`` by data quality; both sides must be unique on ``keys``.

    If the new row has no more nulls than the old one its values win where present, otherwise they only
    fill holes. New keys without an old row are not added.
    """
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], null_count(columns).alias("_new_nulls"))
    joined = old.join(fresh, list(keys), "left")
    trusted = F.col("_new_nulls") <= null_count(columns)
    merged = {
        c: F.when(trusted, F.coalesce(f"_new_{c}", c)).otherwise(F.coalesce(c, f"_new_{c}")) for c in columns
    }
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in old.columns])


def merge_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert where a null never overwrites a value: ``coalesce(new, old)`` per column."""
    columns = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns]).select(*old.columns)


def map_names(df: DataFrame, lookup: DataFrame, column: str, source: str = "alias", target: str = "name") -> DataFrame:
    """Replace codes by names through a lookup table; unmapped codes stay as they are."""
    pairs = lookup.select(F.col(source).alias(column), F.col(target).alias("_mapped"))
    return (
        df.join(pairs, column, "left")
        .withColumn(column, F.coalesce("_mapped", column))
        .select(*df.columns)
    )


def unmapped_names(df: DataFrame, lookup: DataFrame, column: str, source: str = "alias") -> DataFrame:
    """Names the lookup does not know, with how often they occur."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(lookup.select(F.col(source).alias(column)), column, "left_anti")
