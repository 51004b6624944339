"""Index scales against values worked out by hand from the breakpoint tables."""

import math

import pytest
from pyspark.sql import functions as F

from airgrid.functions import scales

INPUTS = {"pm25": 35.0, "pm10": 150.0, "o3": 60.0, "co": 5.0, "so2": 40.0, "no2": 70.0}
EXPECTED = {
    "rounded": {"pm25": 99, "pm10": 98, "o3": 28, "co": 0, "so2": 22, "no2": 35},
    "gapped": {"pm25": 99, "pm10": 98, "o3": 67, "co": 56, "so2": 56, "no2": 68},
    "unconverted": {"pm25": 99, "pm10": 98, "o3": 69, "co": 56, "so2": 56, "no2": 68},
    "continuous": {"pm25": 99.1453, "pm10": 98.0, "o3": 68.75, "co": 56.0, "so2": 56.25, "no2": 68.0851},
}


def one(spark, value, pollutant, scale):
    df = spark.createDataFrame([(value,)], "c DOUBLE")
    return df.select(scales.score("c", pollutant, scale).alias("s")).first().s


@pytest.mark.parametrize("scale", scales.SCALES)
def test_worked_example(spark, scale):
    df = spark.createDataFrame([tuple(INPUTS.values())], ", ".join(f"{p} DOUBLE" for p in INPUTS))
    row = df.select(*[scales.score(p, p, scale).alias(p) for p in INPUTS]).first()
    for p in INPUTS:
        assert row[p] == pytest.approx(EXPECTED[scale][p], abs=1e-4), p


@pytest.mark.parametrize(
    "value,pollutant,scale,want",
    [
        (54.5, "pm10", "gapped", None), (54.5, "pm10", "rounded", 50.0), (-1.0, "pm25", "rounded", None), (600.0, "pm25", "rounded", 500.0),
        (600.0, "pm25", "unconverted", 500.0), (600.0, "pm25", "gapped", None), (None, "pm25", "rounded", None), (float("nan"), "pm25", "rounded", None),
        (float("nan"), "co", "continuous", None), (None, "co", "continuous", None), (400.0, "o3", "gapped", 500.0), (401.0, "o3", "gapped", None),
        (12.0, "pm25", "rounded", 50.0), (500.4, "pm25", "rounded", 500.0), (54.9, "o3", "gapped", 50.0), (400.0, "pm25", "continuous", 400.0),
        (549.6, "pm25", "continuous", 500.0),
    ],
)
def test_edges(spark, value, pollutant, scale, want):
    got = one(spark, value, pollutant, scale)
    assert (got is None and want is None) or got == pytest.approx(want)


def test_every_break_point_of_the_rounded_scale(spark):
    for p, breaks in scales.BREAKS.items():
        factor = scales.GAS_FACTORS.get(p, 1.0)
        got = [one(spark, float(b), p, "unconverted") for b in breaks]
        assert got == [float(i) for i in scales.INDEX], p
        assert one(spark, (breaks[3] - 1e-9) / factor, p, "rounded") == 150.0


def test_index_never_falls_as_concentration_rises(spark):
    df = spark.range(0, 3000).select((F.col("id") * 0.9).alias("c"))
    for scale in ("rounded", "unconverted", "continuous"):
        for p in scales.BREAKS:
            values = [r.s for r in df.select("c", scales.score("c", p, scale).alias("s")).orderBy("c").collect()]
            assert all(a <= b for a, b in zip(values, values[1:])), (scale, p)


def test_category_and_overall(spark):
    rows = [(50.0, "Good"), (50.5, "Moderate"), (300.0, "Very Unhealthy"), (301.0, "Hazardous"), (None, "Unknown"), (math.nan, "Unknown")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "i DOUBLE")
    assert [r.c for r in df.select(scales.category(F.col("i")).alias("c")).collect()] == [c for _, c in rows]
    some = spark.createDataFrame([(1.0, None, math.nan), (None, None, None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = [r.m for r in some.select(scales.overall([F.col("a"), F.col("b"), F.col("c")]).alias("m")).collect()]
    assert got == [1.0, None]


def test_sql_functions_agree_with_the_column_builders(spark):
    from airgrid.functions.sqlfuncs import register

    assert "aqi_o3" in register(spark)
    df = spark.range(0, 200).selectExpr("id * 3.7D AS c")
    for p in scales.BREAKS:
        both = df.select(F.expr(f"aqi_{p}(c)").alias("a"), scales.score("c", p).alias("b"))
        assert both.where("NOT a <=> b").count() == 0
    got = spark.sql("SELECT parse_wind_kmh('10 mph') a, parse_humidity('39%') b, parse_celsius('85') c, aqi_category(301D) d").first()
    assert (got.a, got.b, got.c, got.d) == (16.1, 39.0, 29.0, "Hazardous")
