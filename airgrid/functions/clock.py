"""Time columns: zone shifts, truncation, calendar parts and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Bangkok"  # fixed +07:00, no daylight saving


def floor_to(time: Column, unit: str = "hour") -> Column:
    """Truncate a zone-free time; ``date_trunc`` returns an instant, so cast back."""
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def nearest_second(time: Column) -> Column:
    return F.date_trunc("second", time + F.expr("INTERVAL 500 MILLISECONDS")).cast("timestamp_ntz")


def epoch_seconds(time: Column) -> Column:
    return F.unix_seconds(time.cast("timestamp"))


def epoch_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def utc_to_local(time: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall time (zone-free) or instant -> local wall time, zone-free."""
    return F.from_utc_timestamp(time.cast("timestamp"), zone).cast("timestamp_ntz")


def local_to_utc(time: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(time.cast("timestamp"), zone).cast("timestamp_ntz")


def epoch_to_local(seconds: Column, zone: str = LOCAL_ZONE) -> Column:
    return utc_to_local(F.timestamp_seconds(seconds), zone)


def drop_zone(time: Column) -> Column:
    return time.cast("timestamp_ntz")


def parse_time(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """First format that fits, else null. With no formats, any ISO-like text (offsets allowed)."""
    tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats] or [text.try_cast("timestamp")]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def iso_text(time: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local wall time as ISO-8601 with the zone's fixed offset."""
    offset = {"Asia/Bangkok": "+07:00", "UTC": "+00:00"}[zone]
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def weekday(time: Column) -> Column:
    """Monday is 0."""
    return F.weekday(time)


def calendar(time: Column) -> dict[str, Column]:
    day = F.weekday(time)
    return {
        "hour": F.hour(time),
        "day_of_week": day,
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "day_of_year": F.dayofyear(time),
        "is_weekend": (day >= 5).cast("int"),
    }


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def cyclic_calendar(time: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, part, period in (
        ("hour", F.hour(time), 24),
        ("day_of_week", F.weekday(time), 7),
        ("month", F.month(time), 12),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part, period)
    return out


def period_flags(time: Column) -> dict[str, Column]:
    hour = F.hour(time)
    return {
        "is_morning_rush": hour.between(7, 9).cast("int"),
        "is_evening_rush": hour.between(17, 19).cast("int"),
        "is_night": ((hour >= 22) | (hour <= 5)).cast("int"),
        "is_daytime": ((hour >= 6) & (hour < 18)).cast("int"),
    }


def recency_weight(time: Column, latest: Column, rate: float = 0.1) -> Column:
    """exp(-rate * days before ``latest``)."""
    days = (epoch_micros(latest) - epoch_micros(time)) / F.lit(86_400_000_000.0)
    return F.exp(F.lit(-rate) * days)
