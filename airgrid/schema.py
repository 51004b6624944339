"""Canonical column names and the schemas of the landed sources."""

from __future__ import annotations

from pyspark.sql import types as T

POLLUTANTS = ["pm25", "pm10", "o3", "co", "so2", "no2"]
WEATHER_NUMERIC = ["temperature", "pressure", "humidity", "wind_speed", "wind_direction", "dew"]
WEATHER = [*WEATHER_NUMERIC, "weather_icon"]
KEY = ["station", "time"]

# Spellings met in feeds -> canonical parameter name (dots need back-ticks in Spark).
PARAMETER_ALIASES = {"pm2.5": "pm25", "pm_25": "pm25", "pm2_5": "pm25", "pm_10": "pm10"}

_d, _s, _t = T.DoubleType(), T.StringType(), T.TimestampNTZType()


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in kinds.items()])


READING = fields(station=_s, parameter=_s, time=_t, value=_d)

MERGED = T.StructType(
    [T.StructField("time", _t), T.StructField("station", _s)]
    + [T.StructField(name, _d) for name in POLLUTANTS + WEATHER_NUMERIC]
    + [T.StructField("weather_icon", _s)]
)

WIDE_CSV = fields(
    location_id=T.LongType(), location_name=_s, datetimeUtc=_s, datetimeLocal=_s, latitude=_d, longitude=_d,
    co=_d, no2=_d, o3=_d, pm10=_d, pm25=_d, so2=_d,
)

FORECAST_CSV = fields(
    time=_t, location=_s, temperature=_d, pressure=_d, humidity=_d, wind_speed=_d, wind_direction=_d,
    weather_icon=_s, dew=_d,
)

WEATHER_TEXT_CSV = fields(timestamp=_s, weather_icon=_s, wind_speed=_s, humidity=_s, temperature=_s, location=_s)

# {station: {"stat"|"aqi": {pollutant: [{time, value or the pollutant's name: number}]}}}: one map column.
STATION_DUMP = T.MapType(
    _s, T.MapType(_s, T.MapType(_s, T.ArrayType(T.MapType(_s, _s))))
)

MEASUREMENT_RECORD = fields(
    location_id=T.LongType(),
    location_name=_s,
    timezone=_s,
    country_iso=_s,
    isMobile=T.BooleanType(),
    isMonitor=T.BooleanType(),
    owner_name=_s,
    provider=_s,
    coordinates=fields(latitude=_d, longitude=_d),
    results=T.ArrayType(
        fields(
            value=_d,
            parameter=fields(name=_s, units=_s),
            period=fields(datetimeFrom=fields(utc=_s)),
            coverage=fields(datetimeFrom=fields(local=_s)),
        )
    ),
)

HOURLY_FORECAST = fields(
    location=_s,
    hourly=T.ArrayType(
        fields(
            dt=T.LongType(), temp=_d, dew_point=_d, pressure=_d, humidity=_d, wind_speed=_d, wind_deg=_d,
            weather=T.ArrayType(fields(icon=_s)),
        )
    ),
)
