"""The scalar functions under SQL names, as SQL-bodied functions Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from airgrid.functions.scales import BANDS, BREAKS, score_text


def register(spark: SparkSession) -> list[str]:
    """Create ``aqi_<pollutant>``, ``aqi_category``, ``parse_wind_kmh``, ``parse_celsius`` and friends."""
    bodies = {f"aqi_{p}(c DOUBLE) RETURNS DOUBLE": score_text("c", p) for p in BREAKS}
    bands = " ".join(f"WHEN i <= {top} THEN '{name}'" for top, name, _ in BANDS[:-1])
    bodies["aqi_category(i DOUBLE) RETURNS STRING"] = (
        f"CASE WHEN i IS NULL OR isnan(i) THEN 'Unknown' {bands} ELSE '{BANDS[-1][1]}' END"
    )
    number = r"^(\\d+(?:\\.\\d+)?)\\s*(km/h|mph)$"
    wind = f"try_cast(nullif(regexp_extract(trim(t), '{number}', 1), '') AS DOUBLE)"
    bodies["parse_wind_kmh(t STRING) RETURNS DOUBLE"] = (
        f"CASE WHEN regexp_extract(trim(t), '{number}', 2) = 'mph' THEN bround({wind} * 1.60934D, 1) ELSE {wind} END"
    )
    bodies["parse_humidity(t STRING) RETURNS DOUBLE"] = (
        r"try_cast(nullif(regexp_extract(trim(t), '^(\\d{1,3})%$', 1), '') AS DOUBLE)"
    )
    degrees = r"(?i)([-+]?\\d+(?:\\.\\d+)?)\\s*°?\\s*([cf])?"
    amount = f"try_cast(nullif(regexp_extract(t, '{degrees}', 1), '') AS DOUBLE)"
    mark = f"upper(regexp_extract(t, '{degrees}', 2))"
    bodies["parse_celsius(t STRING) RETURNS DOUBLE"] = (
        f"CASE WHEN {mark} = 'F' OR ({mark} = '' AND {amount} > 50) THEN bround(({amount} - 32) * 5D / 9D, 0) ELSE {amount} END"
    )
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
