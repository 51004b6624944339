"""Unit texts, icons and times."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airgrid.functions import clock, icons, rows, textunits


def ask(spark, fn, values, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_wind(spark):
    assert ask(spark, textunits.wind_kmh, ["10 mph", "8.5 km/h", "8.5", "abc", None, "1.5 knots"]) == [16.1, 8.5, None, None, None, None]
    assert ask(spark, textunits.wind_text, ["10 mph", " 8.5 km/h ", "x"]) == ["16.1 km/h", "8.5 km/h", None]


def test_humidity(spark):
    assert ask(spark, textunits.humidity_percent, ["39%", "1000%", "39", " 100% ", None]) == [39.0, None, None, 100.0, None]
    assert ask(spark, textunits.humidity_text, [" 39% ", "x"]) == ["39%", None]


def test_temperature_keeps_its_sign(spark):
    assert ask(spark, textunits.celsius, ["85", "28°C", "-3°", "abc", "85F", "50", "-12.5°C", None]) == [29.0, 28.0, -3.0, None, 29.0, 50.0, -12.5, None]
    assert ask(spark, lambda c: textunits.celsius(c, "F"), ["50", "50°C"]) == [10.0, 50.0]
    assert ask(spark, textunits.celsius_text, ["82F"]) == ["28°C"]


def test_numbers(spark):
    assert ask(spark, textunits.to_number, ["1.5", "abc", "5F", "", "-2e3", None, "NaN"]) == [1.5, None, None, None, -2000.0, None, None]
    assert ask(spark, textunits.strip_unit, ["10.2 km/h", "39%", "28°C", "28°", "7F"]) == [10.2, 39.0, 28.0, 28.0, None]
    assert ask(spark, textunits.first_number, ["a -3.5 b", "none", "7x8"]) == [-3.5, None, 7.0]
    assert ask(spark, textunits.with_kmh, [10.25, 10.35], "DOUBLE") == ["10.2 km/h", "10.4 km/h"]
    assert ask(spark, textunits.kelvin_to_celsius, [300.0], "DOUBLE") == [26.85]


def test_icons(spark):
    assert ask(spark, icons.icon_label, ["/x/ic-w-06-rain-full.svg", "/x/own.svg", "rain", None]) == ["rain", "own.svg", "rain", None]
    assert ask(spark, icons.category_by_text, ["partly-cloudy-night", "CLOUDY", "light-rain", "mist"]) == ["partly_cloudy", "cloudy", "rain", "other"]
    assert ask(spark, icons.category_exact, ["mist", "rain", "x"]) == ["mist", "rain", "other"]
    assert ask(spark, icons.icon_code, ["04d", "10n"]) == ["04", "10"]


def test_times(spark):
    t = dt.datetime(2024, 1, 1, 20, 30, 15, 600000)
    df = spark.createDataFrame([(t,)], "t TIMESTAMP_NTZ")
    c = F.col("t")
    r = df.select(
        clock.utc_to_local(c).alias("local"), clock.local_to_utc(c).alias("utc"), clock.floor_to(c).alias("hour"), clock.nearest_second(c).alias("sec"),
        clock.iso_text(c).alias("iso"), clock.weekday(c).alias("dow"), clock.epoch_to_local(F.lit(0)).alias("zero"),
    ).first()
    assert r.local == dt.datetime(2024, 1, 2, 3, 30, 15, 600000)
    assert r.utc == dt.datetime(2024, 1, 1, 13, 30, 15, 600000)
    assert r.hour == dt.datetime(2024, 1, 1, 20) and r.sec == dt.datetime(2024, 1, 1, 20, 30, 16)
    assert r.iso == "2024-01-01T20:30:15+07:00" and r.dow == 0 and r.zero == dt.datetime(1970, 1, 1, 7)


def test_offset_text_becomes_an_instant(spark):
    got = ask(spark, lambda c: clock.utc_to_local(clock.parse_time(c)), ["2025-05-11 07:00:00+07:00", "bad"])
    assert got == [dt.datetime(2025, 5, 11, 7), None]


def test_values(spark):
    assert ask(spark, rows.finite, [1.0, float("inf"), float("-inf"), float("nan"), None], "DOUBLE") == [1.0, None, None, None, None]
    assert ask(spark, lambda c: rows.clip(c, 0, 10), [-1.0, 5.0, 11.0, None], "DOUBLE") == [0.0, 5.0, 10.0, None]
    assert ask(spark, lambda c: rows.gauge(c, 0, 500), [250.0, 600.0], "DOUBLE") == [0.5, 1.0]
    assert ask(spark, lambda c: rows.min_max(c, F.lit(0.0), F.lit(4.0), True), [1.0], "DOUBLE") == [0.75]


@pytest.mark.parametrize("hour,flags", [(7, (1, 0, 0, 1)), (19, (0, 1, 0, 0)), (22, (0, 0, 1, 0)), (5, (0, 0, 1, 0)), (6, (0, 0, 0, 1))])
def test_period_flags(spark, hour, flags):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, hour),)], "t TIMESTAMP_NTZ")
    assert tuple(df.select(*clock.period_flags(F.col("t")).values()).first()) == flags
