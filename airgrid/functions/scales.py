"""Air-quality index scales as CASE chains built from breakpoint tables.

Four scales exist side by side and give different numbers, so each has its own name:
``rounded`` (gases converted to ppm/ppb first), ``unconverted`` (the same without conversion),
``gapped`` (inclusive ranges with holes between them) and ``continuous`` (no rounding, no cap).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Concentration break points, index break points, unit factors, band names and colours.
BREAKS = {
    "pm25": [0, 12.0, 35.4, 55.4, 150.4, 250.4, 350.4, 500.4],
    "pm10": [0, 54, 154, 254, 354, 424, 504, 604],
    "o3": [0, 54, 70, 85, 105, 200, 404, 504],
    "co": [0, 4.4, 9.4, 12.4, 15.4, 30.4, 40.4, 50.4],
    "so2": [0, 35, 75, 185, 304, 604, 804, 1004],
    "no2": [0, 53, 100, 360, 649, 1249, 1649, 2049],
}
INDEX = [0, 50, 100, 150, 200, 300, 400, 500]
GAS_FACTORS = {"co": 0.000872, "so2": 0.381, "no2": 0.531, "o3": 0.5094}
GAPPED_O3_TOP = [300, 400]
GAPPED_STEP = {"pm25": 0.1, "pm10": 1, "o3": 1, "co": 0.1, "so2": 1, "no2": 1}
CONTINUOUS_TOP = {"pm25": 400, "pm10": 599, "o3": 300, "co": 100, "so2": 1000, "no2": 1999}
BANDS = [
    (50, "Good", "green"),
    (100, "Moderate", "yellow"),
    (150, "Unhealthy for Sensitive Groups", "orange"),
    (200, "Unhealthy", "red"),
    (300, "Very Unhealthy", "purple"),
    (None, "Hazardous", "maroon"),
]

SCALES = ("rounded", "unconverted", "gapped", "continuous")


def segments(scale: str, pollutant: str) -> list[tuple[float, float, float, float]]:
    """(conc_low, conc_high, index_low, index_high) rows of one scale."""
    breaks, index = list(BREAKS[pollutant]), list(INDEX)
    if scale == "continuous":
        # Six pieces; the last one runs from 300 with its own width and is never capped.
        breaks = [*breaks[:6], CONTINUOUS_TOP[pollutant]]
        index = [*index[:6], 400]
    if scale == "gapped":
        if pollutant == "o3":
            breaks[-2:] = GAPPED_O3_TOP
        step = GAPPED_STEP[pollutant]
        lows = [0, *(round(b + step, 1) for b in breaks[1:-1])]
        floors = [0, *(i + 1 for i in index[1:-1])]
        return list(zip(lows, breaks[1:], floors, index[1:]))
    return list(zip(breaks, breaks[1:], index, index[1:]))


def to_ppm(conc: Column, pollutant: str) -> Column:
    """µg/m³ to ppm (co) or ppb (so2, no2, o3); particulates pass through."""
    factor = GAS_FACTORS.get(pollutant)
    return conc if factor is None else conc * F.lit(factor)


def denan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def score_text(arg: str, pollutant: str, scale: str = "rounded") -> str:
    """The index of the SQL expression ``arg`` as one CASE expression in Spark SQL."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}, expected one of {SCALES}")
    rows = segments(scale, pollutant)
    value = f"CAST({arg} AS DOUBLE)"
    if scale == "rounded" and pollutant in GAS_FACTORS:
        value = f"({value} * {GAS_FACTORS[pollutant]}D)"
    if scale == "gapped":
        # Half-even on the decimal text, as every engine we compare with does; others drop the fraction.
        tenths = pollutant in ("pm25", "pm10", "co")
        value = f"bround({value}, 1)" if tenths else f"CAST(CAST({value} AS BIGINT) AS DOUBLE)"

    def line(row: tuple[float, float, float, float]) -> str:
        low, high, floor, ceiling = row
        return f"{(ceiling - floor) / (high - low)!r}D * ({value} - {float(low)}D) + {float(floor)}D"

    if scale == "continuous":
        whens = " ".join(f"WHEN {value} <= {float(r[1])}D THEN {line(r)}" for r in rows[:-1])
        return f"CASE WHEN {arg} IS NULL OR isnan({arg}) THEN NULL {whens} ELSE {line(rows[-1])} END"
    if scale == "gapped":
        whens = " ".join(
            f"WHEN {value} >= {float(r[0])}D AND {value} <= {float(r[1])}D THEN bround({line(r)}, 0)" for r in rows
        )
        return f"CASE WHEN isnan({arg}) THEN NULL {whens} END"
    whens = " ".join(f"WHEN {value} <= {float(r[1])}D THEN bround({line(r)}, 0)" for r in rows)
    return f"CASE WHEN isnan({arg}) OR {arg} < 0 THEN NULL WHEN {value} > {float(rows[-1][1])}D THEN 500D {whens} END"


def score(column: str, pollutant: str, scale: str = "rounded") -> Column:
    """Index of a concentration column; null for a missing (or, except ``continuous``, negative) input."""
    return F.expr(score_text(f"`{column}`", pollutant, scale))


def overall(values: Iterable[Column]) -> Column:
    """Largest available index; nulls are skipped and NaN counts as null."""
    columns = [denan(value) for value in values]
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def category(index: Column) -> Column:
    chain = F.when(index.isNull() | F.isnan(index), F.lit("Unknown"))
    for top, name, _ in BANDS[:-1]:
        chain = chain.when(index <= top, F.lit(name))
    return chain.otherwise(F.lit(BANDS[-1][1]))


def colour(index: Column) -> Column:
    chain = F.when(index.isNull() | F.isnan(index), F.lit("gray"))
    for top, _, paint in BANDS[:-1]:
        chain = chain.when(index <= top, F.lit(paint))
    return chain.otherwise(F.lit(BANDS[-1][2]))


def add_index_columns(df: DataFrame, columns: dict[str, str], scale: str = "rounded") -> DataFrame:
    """Add ``aqi_<pollutant>`` per input column, then ``overall_aqi`` and ``aqi_category``.

    ``columns`` maps pollutant -> concentration column.
    """
    scored = df.withColumns({f"aqi_{p}": score(c, p, scale) for p, c in columns.items()})
    with_max = scored.withColumn("overall_aqi", overall([F.col(f"aqi_{p}") for p in columns]))
    return with_max.withColumn("aqi_category", category(F.col("overall_aqi")))
