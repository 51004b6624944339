"""End-user report queries over the merged hourly table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to
from airgrid.functions.scales import category, colour, overall
from airgrid.operators.dedup import latest_per_key
from airgrid.operators.filters import last_days
from airgrid.schema import POLLUTANTS


def latest_ranked(merged: DataFrame, pollutants: Sequence[str] = tuple(POLLUTANTS)) -> DataFrame:
    """Newest row per station with overall index, band and colour, worst first."""
    newest = latest_per_key(merged).withColumn("overall_aqi", overall([F.col(p) for p in pollutants]))
    return newest.withColumns(
        {"aqi_category": category(F.col("overall_aqi")), "aqi_colour": colour(F.col("overall_aqi"))}
    ).orderBy(F.desc_nulls_last("overall_aqi"), "station")


def index_series(merged: DataFrame, stations: Sequence[str] | None = None) -> DataFrame:
    rows = merged.where(F.col("station").isin(*stations)) if stations else merged
    return rows.select("station", "time", overall([F.col(p) for p in POLLUTANTS]).alias("overall_aqi")).orderBy("station", "time")


def station_detail(merged: DataFrame, station: str) -> DataFrame:
    return merged.where(F.col("station") == station).orderBy(F.desc("time"))


def pollutant_series(merged: DataFrame, station: str, pollutant: str) -> DataFrame:
    rows = merged.where((F.col("station") == station) & F.col(pollutant).isNotNull())
    return rows.select("time", F.col(pollutant).alias("value")).orderBy("time")


def recent_series(readings: DataFrame, days: int = 7, as_of: Column | None = None) -> DataFrame:
    return last_days(readings, days, as_of)


def compare_stations(readings: DataFrame, days: int = 30, pollutants: Sequence[str] = tuple(POLLUTANTS), as_of: Column | None = None) -> DataFrame:
    return last_days(readings, days, as_of).groupBy("station").agg(*[F.avg(p).alias(p) for p in pollutants])


def band_summary(scored: DataFrame, index: str = "overall_aqi") -> DataFrame:
    return scored.groupBy(category(F.col(index)).alias("category")).agg(F.count("*").alias("n"))


def pollutant_vector(merged: DataFrame, pollutants: Sequence[str] = tuple(POLLUTANTS), scale: float = 100.0) -> DataFrame:
    """Newest value of each pollutant per station in long form, null as 0, as a share of ``scale``."""
    newest = latest_per_key(merged.select("station", "time", *pollutants))
    items = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.coalesce(F.col(p), F.lit(0.0)).alias("value")) for p in pollutants])
    return newest.select("station", F.explode(items).alias("e")).select(
        "station", "e.*", (F.col("e.value") / F.lit(scale)).alias("share")
    )


def city_hourly(hourly: DataFrame, numeric: Sequence[str], band: str, time: str = "time") -> DataFrame:
    """City-wide mean per hour and the most common band."""
    return hourly.groupBy(floor_to(F.col(time)).alias("time")).agg(
        *[F.avg(c).alias(c) for c in numeric], F.mode(band, True).alias(band)
    )
