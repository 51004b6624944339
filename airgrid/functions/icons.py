"""Weather icons: file name -> label, label -> category."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Icon file -> label.
ICON_LABELS = {
    "ic-w-01-clear-sky-full.svg": "clear-day",
    "ic-w-01-clear-day-full.svg": "clear-day",
    "ic-w-02-new-clouds-full.svg": "partly-cloudy-day",
    "ic-w-02-wind-full.svg": "wind",
    "ic-w-03-cloudy-full.svg": "cloudy",
    "ic-w-04-scattered-clouds-full.svg": "partly-cloudy-day",
    "ic-w-06-rain-full.svg": "rain",
    "ic-w-07-thunderstorms-full.svg": "thunderstorm",
    "ic-w-09-mist-full.svg": "mist",
    "ic-w-10-night-clear-sky-full.svg": "clear-night",
    "ic-w-11-night-few-clouds-full.svg": "partly-cloudy-night",
    "ic-w-12-night-rain-full.svg": "rain",
}

# Text contained in the icon -> category; the order decides, first match wins.
CONTAINS_CATEGORY = {
    "clear-day": "clear_sky",
    "clear-night": "clear_night",
    "partly-cloudy-day": "partly_cloudy",
    "partly-cloudy-night": "partly_cloudy",
    "cloudy": "cloudy",
    "rain": "rain",
    "light-rain": "rain",
    "thunderstorm": "storm",
    "snow": "snow",
    "fog": "fog",
}

# Whole icon text -> category.
EXACT_CATEGORY = {
    "mist": "mist",
    "partly-cloudy-day": "partly_cloudy",
    "rain": "rain",
    "ic-w-01-clear-sky-full.svg": "clear_sky",
    "ic-w-02-new-clouds-full.svg": "cloudy",
    "ic-w-06-rain-full.svg": "rain",
    "ic-w-10-night-clear-sky-full.svg": "clear_night",
}


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Literal map lookup; unknown keys give ``default`` (or null)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def icon_label(url: Column) -> Column:
    """Label of the last path segment; an unknown file name is kept."""
    name = F.element_at(F.split(url, "/"), -1)
    return lookup(ICON_LABELS, name, name)


def category_by_text(icon: Column) -> Column:
    lowered = F.lower(icon)
    chained = None
    for needle, name in CONTAINS_CATEGORY.items():
        hit = lowered.contains(needle)
        chained = F.when(hit, F.lit(name)) if chained is None else chained.when(hit, F.lit(name))
    return chained.otherwise(F.lit("other"))


def category_exact(icon: Column) -> Column:
    return lookup(EXACT_CATEGORY, icon, F.lit("other"))


def icon_code(icon: Column) -> Column:
    """``04d`` and ``04n`` -> ``04``."""
    return F.substring(icon, 1, 2)
