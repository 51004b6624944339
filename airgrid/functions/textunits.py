"""Parsing and formatting of readings that carry their unit in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_MILE = 1.60934  # fixed value
NUMBER = r"([-+]?\d+(?:\.\d+)?)"


PLAIN_NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_number(text: Column) -> Column:
    """First signed number in the text, null when there is none."""
    return blank_to_null(F.regexp_extract(text, NUMBER, 1)).try_cast("double")


def strip_unit(text: Column) -> Column:
    """``12.5 km/h``, ``39%``, ``28°C``, ``28°`` -> number; anything else -> null."""
    return to_number(F.regexp_replace(F.trim(text), r"\s*(km/h|%|°C|°)$", ""))


def wind_kmh(text: Column) -> Column:
    """Wind in km/h to one decimal; null unless the whole text is ``<number> km/h`` or ``<number> mph``."""
    clean = F.trim(text)
    amount = blank_to_null(F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*(km/h|mph)$", 1)).try_cast("double")
    miles = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*(km/h|mph)$", 2) == "mph"
    return F.when(miles, F.bround(amount * F.lit(KM_PER_MILE), 1)).otherwise(amount)


def wind_text(text: Column) -> Column:
    """Validated wind text: km/h kept as written, mph rewritten as km/h, anything else null."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"mph$"), F.format_string("%.1f km/h", wind_kmh(text))).when(
        wind_kmh(text).isNotNull(), clean
    )


def humidity_percent(text: Column) -> Column:
    """One to three digits and a percent sign, else null."""
    return blank_to_null(F.regexp_extract(F.trim(text), r"^(\d{1,3})%$", 1)).try_cast("double")


def humidity_text(text: Column) -> Column:
    return F.when(humidity_percent(text).isNotNull(), F.trim(text))


def fahrenheit_to_celsius(degrees: Column) -> Column:
    return (degrees - 32) * F.lit(5.0) / F.lit(9.0)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return F.bround(kelvin - F.lit(273.15), 2)


def celsius(text: Column, unit: str = "auto") -> Column:
    """Whole degrees Celsius from ``28°C``, ``82F``, ``85``; keeps the sign.

    ``auto`` reads a bare number above 50 as Fahrenheit; pass ``C`` or ``F`` when the feed states its unit.
    """
    pattern = r"(?i)([-+]?\d+(?:\.\d+)?)\s*°?\s*([cf])?"
    amount = blank_to_null(F.regexp_extract(text, pattern, 1)).try_cast("double")
    mark = F.upper(F.regexp_extract(text, pattern, 2))
    if unit == "auto":
        fahrenheit = (mark == "F") | ((mark == "") & (amount > 50))
    else:
        fahrenheit = (mark == "F") | ((mark == "") & F.lit(unit == "F"))
    return F.when(fahrenheit, F.bround(fahrenheit_to_celsius(amount), 0)).otherwise(amount)


def celsius_text(text: Column, unit: str = "auto") -> Column:
    return F.concat(celsius(text, unit).cast("long").cast("string"), F.lit("°C"))


def with_kmh(speed: Column) -> Column:
    return F.when(speed.isNotNull(), F.format_string("%.1f km/h", F.bround(speed, 1)))


def with_percent(share: Column) -> Column:
    return F.concat(share.cast("long").cast("string"), F.lit("%"))


def to_number(text: Column) -> Column:
    """Bad text becomes null instead of an error. The pattern keeps out ``5F`` and ``5D``, which a cast
    to double would take for a Java number."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
