"""The ``events`` table read as sensor feeds.

Stations, parameters, weather and unit texts are expressions over each event; every feed covers the
whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to
from airgrid.operators.reshape import mean_by_parameter
from airgrid.schema import POLLUTANTS

PARAMETER_OF = {"error": "pm25", "click": "pm10", "view": "no2", "purchase": "so2", "signup": "co"}
MEASURED = ["pm25", "pm10", "no2", "so2", "co"]  # o3 is absent, as in real feeds
STATIONS = 5
HUB = "S0"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def parameter_of(kind: Column) -> Column:
    chain = None
    for name, parameter in PARAMETER_OF.items():
        chain = F.when(kind == name, parameter) if chain is None else chain.when(kind == name, parameter)
    return chain


def station_of(user: Column) -> Column:
    return F.concat(F.lit("S"), (user % STATIONS).cast("string"))


def payload(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("double")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, station, time, parameter, value): the long raw feed."""
    return events(spark, sf_dir).select(
        "event_id",
        station_of(F.col("user_id")).alias("station"),
        F.col("ts").alias("time"),
        parameter_of(F.col("event_type")).alias("parameter"),
        "value",
    )


def raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its value in the column of its pollutant."""
    r = readings(spark, sf_dir)
    return r.select(
        "event_id", "station", "time",
        *[F.when(F.col("parameter") == p, F.col("value")).alias(p) for p in POLLUTANTS],
    )


def hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, time, six pollutants): hourly means; one shuffle, combined before it."""
    r = readings(spark, sf_dir).withColumn("time", floor_to(F.col("time")))
    return mean_by_parameter(r, ["station", "time"], "parameter", "value", POLLUTANTS)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weather rows: numbers derived from the payload, icon from the event type. Temperature is
    missing on purchases and pressure on signups, so there are nulls to fill."""
    e = events(spark, sf_dir)
    k = payload(F.col("props"))
    kind = F.col("event_type")
    return e.select(
        "event_id",
        station_of(F.col("user_id")).alias("station"),
        F.col("ts").alias("time"),
        F.when(kind != "purchase", k / 2).alias("temperature"),
        F.when(kind != "signup", k / 10 + 1000).alias("pressure"),
        (F.lit(100.0) - k).alias("humidity"),
        (F.col("value") / 10).alias("wind_speed"),
        (k * 3.6).alias("wind_direction"),
        (k / 4).alias("dew"),
        kind.alias("weather_icon"),
    )


def weather_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather as text with units; some rows use other units or are malformed on purpose."""
    e = events(spark, sf_dir)
    k = payload(F.col("props")).cast("int")
    speed = F.format_string("%.1f", F.bround(F.col("value"), 1))
    kind = F.col("event_type")
    return e.select(
        "event_id",
        station_of(F.col("user_id")).alias("station"),
        F.col("ts").alias("time"),
        F.concat(speed, F.when(kind == "click", " mph").when(kind == "error", " knots").otherwise(" km/h")).alias("wind_speed"),
        F.concat(F.when(kind == "signup", k * 11).otherwise(k).cast("string"), F.lit("%")).alias("humidity"),
        F.when(kind == "view", F.concat(k.cast("string"), F.lit("F")))
        .when(kind == "purchase", F.concat((k - 50).cast("string"), F.lit("°C")))
        .when(kind == "error", F.lit("n/a"))
        .otherwise(k.cast("string"))
        .alias("temperature"),
        F.concat(
            F.lit("/icons/"),
            F.when(kind == "click", "ic-w-06-rain-full.svg").when(kind == "view", "ic-w-01-clear-sky-full.svg")
            .when(kind == "purchase", "Partly-Cloudy-Night").when(kind == "signup", "light-rain").otherwise("mist"),
        ).alias("icon_url"),
    )


def hourly_weather_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, time, weather): hourly means and most common icon."""
    from airgrid.operators.buckets import hourly_weather
    from airgrid.schema import WEATHER_NUMERIC

    return hourly_weather(weather(spark, sf_dir), WEATHER_NUMERIC, "weather_icon")
