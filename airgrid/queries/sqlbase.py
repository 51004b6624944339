"""Common table expressions of the reference SQL, over the same given tables."""

from __future__ import annotations

from airgrid.schema import POLLUTANTS, WEATHER_NUMERIC

PARAMETER_CASE = (
    "CASE event_type WHEN 'error' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'view' THEN 'no2' "
    "WHEN 'purchase' THEN 'so2' WHEN 'signup' THEN 'co' END"
)
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
STATION = "'S' || CAST(user_id % 5 AS VARCHAR)"


def hourly_means(source: str) -> str:
    cells = ", ".join(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in POLLUTANTS)
    return f"SELECT station, date_trunc('hour', time) AS time, {cells} FROM {source} GROUP BY 1, 2"


def lit(x: float) -> str:
    """A DOUBLE literal (a plain decimal would be DECIMAL)."""
    return f"{float(x)!r}e0"


def half_even_tenth(c: str) -> str:
    """One decimal, half to even on the decimal digits; ``c`` has at most six decimals."""
    d = f"(CAST({c} AS DECIMAL(18, 6)) * 10)"
    up = f"({d} - trunc({d})) > 0.5 OR (({d} - trunc({d})) = 0.5 AND CAST(trunc({d}) AS BIGINT) % 2 = 1)"
    return f"((CAST(trunc({d}) AS BIGINT) + CASE WHEN {up} THEN 1 ELSE 0 END) / 10e0)"


# Fixed values, written out here once more so that a wrong one in the engine shows: concentrations at the index values
# 0, 50, 100, 150, 200, 300, 400 and 500.
TOPS = {
    "pm25": (0, 12, 35.4, 55.4, 150.4, 250.4, 350.4, 500.4),
    "pm10": (0, 54, 154, 254, 354, 424, 504, 604),
    "o3": (0, 54, 70, 85, 105, 200, 404, 504),
    "co": (0, 4.4, 9.4, 12.4, 15.4, 30.4, 40.4, 50.4),
    "so2": (0, 35, 75, 185, 304, 604, 804, 1004),
    "no2": (0, 53, 100, 360, 649, 1249, 1649, 2049),
}
AT = (0, 50, 100, 150, 200, 300, 400, 500)
# The gapped scale's ranges: first and last concentration, first and last index.
GAPPED = {
    "pm25": ((0, 12, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)),
    "pm10": ((0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300), (425, 504, 301, 400), (505, 604, 401, 500)),
    "o3": ((0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150), (86, 105, 151, 200), (106, 200, 201, 300), (201, 300, 301, 400), (301, 400, 401, 500)),
    "co": ((0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400), (40.5, 50.4, 401, 500)),
    "so2": ((0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150), (186, 304, 151, 200), (305, 604, 201, 300), (605, 804, 301, 400), (805, 1004, 401, 500)),
    "no2": ((0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150), (361, 649, 151, 200), (650, 1249, 201, 300), (1250, 1649, 301, 400), (1650, 2049, 401, 500)),
}
# The continuous scale ends in one piece from index 300 to 400, up to these concentrations, and goes on beyond.
LAST = {"pm25": 400, "pm10": 599, "o3": 300, "co": 100, "so2": 1000, "no2": 1999}
TO_PPM = {"co": "0.000872e0", "so2": "0.381e0", "no2": "0.531e0", "o3": "0.5094e0"}


def pieces(pollutant: str, scale: str) -> list[tuple[float, float, float, float]]:
    tops = TOPS[pollutant]
    if scale == "gapped":
        return list(GAPPED[pollutant])
    if scale == "continuous":
        return [*zip(tops[:5], tops[1:6], AT[:5], AT[1:6]), (tops[5], LAST[pollutant], 300, 400)]
    return list(zip(tops, tops[1:], AT, AT[1:]))


def score(pollutant: str, scale: str, c: str) -> str:
    rows = pieces(pollutant, scale)

    def line(row) -> str:
        lo, hi, a, b = row
        return f"{lit((b - a) / (hi - lo))} * (x - {lit(lo)}) + {lit(a)}"

    x = c
    if scale == "rounded" and pollutant in TO_PPM:
        x = f"({c}) * {TO_PPM[pollutant]}"
    if scale == "gapped":
        x = half_even_tenth(c) if pollutant in ("pm25", "pm10", "co") else f"trunc({c})"
        whens = " ".join(f"WHEN x >= {lit(r[0])} AND x <= {lit(r[1])} THEN round_even({line(r)}, 0)" for r in rows)
        body = f"CASE {whens} END"
    elif scale == "continuous":
        whens = " ".join(f"WHEN x <= {lit(r[1])} THEN {line(r)}" for r in rows[:-1])
        body = f"CASE WHEN x IS NULL THEN NULL {whens} ELSE {line(rows[-1])} END"
    else:
        whens = " ".join(f"WHEN x <= {lit(r[1])} THEN round_even({line(r)}, 0)" for r in rows)
        body = f"CASE WHEN x < 0 THEN NULL WHEN x > {lit(rows[-1][1])} THEN 500e0 {whens} END"
    return body.replace("x ", f"({x}) ").replace("(x -", f"(({x}) -")


def category(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} <= 50 THEN 'Good' WHEN {c} <= 100 THEN 'Moderate' WHEN {c} <= 150 THEN 'Unhealthy for Sensitive Groups' "
        f"WHEN {c} <= 200 THEN 'Unhealthy' WHEN {c} <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"
    )


def colour(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'gray' WHEN {c} <= 50 THEN 'green' WHEN {c} <= 100 THEN 'yellow' WHEN {c} <= 150 THEN 'orange' "
        f"WHEN {c} <= 200 THEN 'red' WHEN {c} <= 300 THEN 'purple' ELSE 'maroon' END"
    )


def mode(name: str, source: str, keys: str, column: str) -> str:
    """CTE body: most frequent value per key, smallest among ties."""
    return (
        f"SELECT {keys}, {column} AS {name} FROM (SELECT {keys}, {column}, row_number() OVER (PARTITION BY {keys} "
        f"ORDER BY count(*) DESC, {column}) AS rn FROM {source} WHERE {column} IS NOT NULL GROUP BY {keys}, {column}) WHERE rn = 1"
    )


def interpolated(source: str, columns: list[str], key: str = "station", by: str = "position", edges: str = "both", limit: int | None = None) -> str:
    """CTE body: linear interpolation of the columns; other columns pass through."""
    part = f"PARTITION BY {key} " if key else ""
    x = "pos" if by == "position" else "epoch_us(time)"
    back = f"OVER ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    marks, filled = [], []
    for c in columns:
        for tag, fn, w in (("p", "last_value", back), ("n", "first_value", ahead)):
            marks.append(f"{fn}({c} IGNORE NULLS) {w} AS {tag}v_{c}")
            marks.append(f"{fn}(CASE WHEN {c} IS NOT NULL THEN x END IGNORE NULLS) {w} AS {tag}x_{c}")
            marks.append(f"{fn}(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {w} AS {tag}i_{c}")
        inner = f"CASE WHEN nx_{c} > px_{c} THEN pv_{c} + (nv_{c} - pv_{c}) * ((x - px_{c})::DOUBLE / (nx_{c} - px_{c})) END"
        options = [c, inner] + ([f"pv_{c}"] if edges in ("both", "forward") else []) + ([f"nv_{c}"] if edges == "both" else [])
        value = f"coalesce({', '.join(options)})"
        if limit is not None:
            near = f"pos - pi_{c} <= {limit}" if edges != "both" else f"(pi_{c} IS NULL OR pos - pi_{c} <= {limit})"
            value = f"CASE WHEN {c} IS NOT NULL OR {near} THEN {value} END"
        filled.append(f"{value} AS {c}")
    return (
        f"SELECT * EXCLUDE (pos, x{''.join(f', pv_{c}, px_{c}, pi_{c}, nv_{c}, nx_{c}, ni_{c}' for c in columns)}) REPLACE ({', '.join(filled)}) "
        f"FROM (SELECT *, {', '.join(marks)} FROM (SELECT *, {x} AS x FROM (SELECT *, row_number() OVER ({part}ORDER BY time) AS pos FROM {source})))"
    )


P = ", ".join(POLLUTANTS)
WN = ", ".join(WEATHER_NUMERIC)
_WX_MEANS = ", ".join(f"avg({c}) AS {c}" for c in WEATHER_NUMERIC)

# name -> (needed names, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": ((), f"SELECT event_id, {STATION} AS station, ts AS time, {PARAMETER_CASE} AS parameter, value FROM events"),
    "raw_wide": (
        ("readings",),
        "SELECT event_id, station, time, "
        + ", ".join(f"CASE WHEN parameter = '{p}' THEN value END AS {p}" for p in POLLUTANTS)
        + " FROM readings",
    ),
    "hourly": (("readings",), hourly_means("readings")),
    "scored": (
        ("hourly",),
        "SELECT station, time, " + ", ".join(f"{score(p, 'rounded', p)} AS {p}" for p in POLLUTANTS) + " FROM hourly",
    ),
    "overall": (("scored",), f"SELECT *, greatest({P}) AS overall_aqi FROM scored"),
    "grid": (
        ("hourly",),
        "SELECT station, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM hourly GROUP BY station",
    ),
    "gaps": (("grid", "hourly"), f"SELECT g.station, g.time, {P} FROM grid g LEFT JOIN hourly h ON g.station = h.station AND g.time = h.time"),
    "target_gaps": (
        ("grid", "overall"),
        "SELECT g.station, g.time, o.overall_aqi FROM grid g LEFT JOIN overall o ON g.station = o.station AND g.time = o.time",
    ),
    "target": (("target_gaps",), interpolated("target_gaps", ["overall_aqi"], by="time")),
    "weather": (
        (),
        f"SELECT event_id, {STATION} AS station, ts AS time, CASE WHEN event_type <> 'purchase' THEN {K} / 2 END AS temperature, "
        f"CASE WHEN event_type <> 'signup' THEN {K} / 10 + 1000 END AS pressure, 100e0 - {K} AS humidity, value / 10 AS wind_speed, "
        f"{K} * 3.6e0 AS wind_direction, {K} / 4 AS dew, event_type AS weather_icon FROM events",
    ),
    "wx_icon": (
        ("weather",),
        "SELECT station, hour AS time, weather_icon FROM (SELECT station, date_trunc('hour', time) AS hour, weather_icon, "
        "row_number() OVER (PARTITION BY station, date_trunc('hour', time) ORDER BY count(*) DESC, weather_icon) AS rn "
        "FROM weather GROUP BY 1, 2, 3) WHERE rn = 1",
    ),
    "wx_mean": (("weather",), f"SELECT station, date_trunc('hour', time) AS time, {_WX_MEANS} FROM weather GROUP BY 1, 2"),
    "wx": (("wx_icon", "wx_mean"), "SELECT m.time, m.station, " + WN + ", weather_icon FROM wx_mean m LEFT JOIN wx_icon i ON m.station = i.station AND m.time = i.time"),
    "model_gaps": (
        ("target_gaps", "wx"),
        f"SELECT t.station, t.time, t.overall_aqi, {WN}, weather_icon FROM target_gaps t LEFT JOIN wx w ON t.station = w.station AND t.time = w.time",
    ),
}


def cte(*names: str, **extra: str) -> str:
    """WITH clause of the named parts and what they need, then the extra parts in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = PARTS[name]
        for n in needs:
            add(n)
        done.setdefault(name, body)

    for n in names:
        add(n)
    done.update(extra)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in done.items()) + " "
