"""Feature frames for forecasting: pooled, per-station and extended variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions import clock, icons
from airgrid.functions.scales import overall
from airgrid.operators import fill, lagging, outliers, reshape
from airgrid.operators.season import decompose
from airgrid.schema import POLLUTANTS
from airgrid.session import cut_lineage

TARGET = "overall_aqi"
LAGS = [1, 2, 3, 6, 12, 24]
ROLLS = [3, 6, 12, 24]
LAGS_EXTENDED = [1, 2, 3, 6, 12, 24, 48, 72, 168]
ROLLS_EXTENDED = [3, 6, 12, 24, 48, 72]
WEATHER_LAGGED = ["temperature", "humidity", "pressure", "wind_speed"]


def with_overall(df: DataFrame, pollutants: Sequence[str] = tuple(POLLUTANTS)) -> DataFrame:
    return df.withColumn(TARGET, overall([F.col(p) for p in pollutants]))


def prepare(df: DataFrame, numeric: Sequence[str], icon: str = "weather_icon") -> DataFrame:
    """Cap extremes, interpolate by time per station, fill the rest by the cascade and the icon by mode.

    The hourly frame is read several times (quantiles, global means), so it is written once first; it is
    small next to the readings it comes from.
    """
    capped = outliers.winsorize_global(cut_lineage(df), numeric)
    smooth = cut_lineage(fill.interpolate(capped, numeric, by="time", edges="both"))
    return fill.fill_key_mode(fill.fill_cascade(smooth, numeric), icon)


def prepare_per_station(df: DataFrame, numeric: Sequence[str], icon: str = "weather_icon") -> DataFrame:
    """The per-station variant: tiered imputation, IQR caps, extreme-event flag."""
    tiered = fill.fill_key_mode(fill.fill_by_tier(df, numeric), icon, max_null_share=0.5)
    return outliers.flag_extreme(outliers.winsorize_iqr(tiered, numeric))


def add_calendar(df: DataFrame, time: str = "time", wind: str | None = "wind_direction") -> DataFrame:
    t = F.col(time)
    columns = clock.calendar(t) | clock.cyclic_calendar(t)
    columns["is_daytime"] = clock.period_flags(t)["is_daytime"]
    if wind and wind in df.columns:
        columns["wind_direction_sin"], columns["wind_direction_cos"] = clock.cyclic(F.col(wind), 360)
    return df.withColumns(columns)


def add_history(df: DataFrame, target: str = TARGET, leakage_safe: bool = True, weather: Sequence[str] = tuple(WEATHER_LAGGED)) -> DataFrame:
    """Lags, statistics of the previous rows, differences and weather lags, all over one window.

    With ``leakage_safe`` a difference never involves the current target; without it the difference is
    x[t] - x[t-k], which together with the lag gives the target away.
    """
    columns = lagging.lags(target, LAGS) | lagging.rolling(target, ROLLS)
    columns |= lagging.diffs(target, [k for k in LAGS if k > 1], shifted=leakage_safe)
    for w in weather:
        if w in df.columns:
            columns |= lagging.lags(w, [1, 24])
    return df.withColumns(columns)


def pooled(df: DataFrame, leakage_safe: bool = True) -> DataFrame:
    """Features of all stations for one pooled model; the first 24 rows of a station are left out."""
    built = add_history(add_calendar(df), leakage_safe=leakage_safe)
    trimmed = lagging.skip_first(built, 24)
    return fill.fill_features(trimmed, [c for c in built.columns if "_lag_" in c or "_rolling_" in c or "_diff_" in c])


def extended(df: DataFrame, target: str = TARGET, leakage_safe: bool = True) -> DataFrame:
    """Longer lags, windows up to three days, hour and weekday profiles, decomposition, interactions.

    The rolling statistics include the current row unless ``leakage_safe``, which also leaves out the
    profile means and decomposition, as both contain the current value.
    """
    t = F.col("time")
    base = df.withColumns(clock.calendar(t) | clock.cyclic_calendar(t) | clock.period_flags(t))
    columns = lagging.lags(target, LAGS_EXTENDED)
    columns |= lagging.rolling(target, ROLLS_EXTENDED, ("mean", "std"), include_current=not leakage_safe)
    columns |= lagging.rolling(target, [24], ("min", "max"), include_current=not leakage_safe)
    columns |= lagging.diffs(target, [1, 24], shifted=leakage_safe)
    built = base.withColumns(columns)
    if not leakage_safe:
        built = decompose(built.withColumns(lagging.profile_means(target)), target)
    extra = {}
    if "temperature" in df.columns:
        extra["temp_hour_interaction"] = F.col("temperature") * F.col("hour")
    if "humidity" in df.columns:
        extra["humidity_hour_interaction"] = F.col("humidity") * F.col("hour")
    if "pm25" in df.columns and "pm10" in df.columns:
        extra["pm25_pm10_ratio"] = F.col("pm25") / (F.col("pm10") + 0.001)
    return built.withColumns(extra).na.drop("any") if extra else built.na.drop("any")


def add_dummies(df: DataFrame, station_levels: Sequence[str], icon_levels: Sequence[str] = ()) -> DataFrame:
    out = reshape.one_hot(df, "station", station_levels)
    if icon_levels:
        out = reshape.one_hot(out.withColumn("weather", icons.icon_code(F.col("weather_icon"))), "weather", icon_levels)
    return out


# Columns that identify a row, define the target or are text.
NOT_FEATURES = {"time", "station", "weather_icon", "weather", "weather_condition", "is_extreme_event", "is_train", "fold", "aqi_category"}


def feature_columns(df: DataFrame, target: str = TARGET, exclude: Sequence[str] = (), leakage_safe: bool = True) -> list[str]:
    """Numeric columns usable as features. The pollutants define the target of the same hour, so they are
    left out unless ``leakage_safe`` is off."""
    banned = NOT_FEATURES | {target, *exclude}
    if leakage_safe:
        banned |= set(POLLUTANTS) | {f"aqi_{p}" for p in POLLUTANTS}
    numeric = {"double", "int", "bigint", "float", "smallint", "tinyint"}
    return [name for name, kind in df.dtypes if kind in numeric and name not in banned and not name.startswith("_")]


