"""Recursive, pattern-based and blended forecasts."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.functions import clock, icons
from airgrid.operators.grid import future_hours
from airgrid.operators.lagging import last_rows
from airgrid.plans.features import TARGET
from airgrid.plans.training import category_levels
from airgrid.schema import WEATHER_NUMERIC
from airgrid.session import cut_lineage

ICON = "weather_icon"
RATIO = "pm25_pm10_ratio"


def future_weather(
    history: DataFrame, steps: int, forecast: DataFrame | None = None, columns: Sequence[str] = tuple(WEATHER_NUMERIC)
) -> DataFrame:
    """(station, time, horizon, weather): the external forecast where there is one, else the last value."""
    ahead = future_hours(history, steps)
    last = last_rows(history.select("station", "time", *columns), 1).drop("time")
    known = ahead.join(last, "station", "left")
    if forecast is None:
        return known
    outside = forecast.select("station", "time", *[F.col(c).alias(f"_fc_{c}") for c in columns if c in forecast.columns])
    joined = known.join(outside, ["station", "time"], "left")
    return joined.select(
        "station", "time", "horizon",
        *[(F.coalesce(f"_fc_{c}", c) if c in forecast.columns else F.col(c)).alias(c) for c in columns],
    )


def rows_needed(columns: Sequence[str]) -> int:
    """How many past rows the features look back on: the longest lag, window or shifted difference."""
    needed = [1]
    for c in columns:
        if m := re.fullmatch(r".+_(lag|diff|rolling_[a-z]+)_(\d+)h", c):
            needed.append(int(m[2]) + (m[1] == "diff"))
    return max(needed)


def _recent(array: Column, k: int) -> Column:
    """k-th newest element, null before the first."""
    return F.try_element_at(array, F.lit(-k))


def _rolled(history: Column, stat: str, width: int) -> Column:
    part = F.slice(history, -width, width)
    if stat in ("min", "max"):
        return F.array_min(part) if stat == "min" else F.array_max(part)
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    if stat == "mean":
        return total / width
    square = F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(F.greatest(square - total * total / width, F.lit(0.0)) / (width - 1))


# Sums and counts of the target by hour of day and by weekday.
PROFILE = {"_hour_sum": 24, "_hour_n": 24, "_dow_sum": 7, "_dow_n": 7}


def profiled(columns: Sequence[str], target: str) -> bool:
    return any(c in (f"{target}_hour_avg", f"{target}_dow_avg") for c in columns)


def profile_state(history: DataFrame, target: str) -> DataFrame:
    """One row per station: the accumulators of its hour and weekday means, from one combined aggregate."""
    value, known = F.col(target), F.col(target).isNotNull()
    parts = {"_hour": (F.hour("time"), 24), "_dow": (F.weekday("time"), 7)}
    sums = {f"{n}_sum": [F.coalesce(F.sum(F.when(at == i, value)), F.lit(0.0)).cast("double") for i in range(size)] for n, (at, size) in parts.items()}
    counts = {f"{n}_n": [F.count_if((at == i) & known).cast("double") for i in range(size)] for n, (at, size) in parts.items()}
    return history.groupBy("station").agg(*[F.array(*v).alias(n) for n, v in (sums | counts).items()])


def profile_means_at(profile: dict[str, Column], t: Column, target: str) -> dict[str, Column]:
    out = {}
    for name, at in (("hour", F.hour(t)), ("dow", F.weekday(t))):
        n = F.get(profile[f"_{name}_n"], at)
        out[f"{target}_{name}_avg"] = F.when(n > 0, F.get(profile[f"_{name}_sum"], at) / n)
    return out


def profile_with(profile: dict[str, Column], t: Column, value: Column) -> dict[str, Column]:
    """The accumulators with one more value."""

    def added(c: str, at: Column, add: Column) -> Column:
        # One by one: a lambda here would meet its own variables again when Catalyst joins the projections of several steps.
        return F.array(*[F.get(profile[c], F.lit(i)) + F.when(at == i, add).otherwise(F.lit(0.0)) for i in range(PROFILE[c])])

    out = {}
    for name, at in (("hour", F.hour(t)), ("dow", F.weekday(t))):
        out[f"_{name}_sum"] = added(f"_{name}_sum", at, value)
        out[f"_{name}_n"] = added(f"_{name}_n", at, F.lit(1.0))
    return out


def serving_features(
    columns: Sequence[str], history: Column, step: Column, weather: Sequence[str], past: int, target: str = TARGET, profile: dict[str, Column] | None = None,
) -> dict[str, Column]:
    """Those of ``columns`` that look back or ahead, for the hour ``step`` hours after the history.

    ``history`` is oldest to newest, with nulls in front if it is short; weather arrays hold ``past`` past
    hours and then the future ones. ``profile`` are the accumulators of hour and weekday means up to that hour.
    """
    at = lambda w, back: F.get(F.col(f"_w_{w}"), step + (past - 1 - back))
    out: dict[str, Column] = profile_means_at(profile, _hour(step), target) if profile else {}
    for c in columns:
        name, _, tail = c.partition(f"{target}_")
        if not name and (m := re.fullmatch(r"lag_(\d+)h", tail)):
            out[c] = _recent(history, int(m[1]))
        elif not name and (m := re.fullmatch(r"diff_(\d+)h", tail)):
            out[c] = _recent(history, 1) - _recent(history, 1 + int(m[1]))
        elif not name and (m := re.fullmatch(r"rolling_(mean|std|min|max)_(\d+)h", tail)):
            out[c] = _rolled(history, m[1], int(m[2]))
        elif (m := re.fullmatch(r"(.+)_lag_(\d+)h", c)) and m[1] in weather:
            out[c] = at(m[1], int(m[2]))
        elif c in weather:
            out[c] = at(c, 0)
        elif c in ("wind_direction_sin", "wind_direction_cos") and "wind_direction" in weather:
            out[c] = clock.cyclic(at("wind_direction", 0), 360)[c.endswith("cos")]
        elif c in ("temp_hour_interaction", "humidity_hour_interaction"):
            source = "temperature" if c.startswith("temp") else "humidity"
            if source in weather:
                out[c] = at(source, 0) * F.hour(_hour(step))
        elif c == RATIO and {"pm25", "pm10"} <= set(weather):
            out[c] = at("pm25", 0) / (at("pm10", 0) + 0.001)
        elif c.startswith("weather_") and ICON in weather:
            out[c] = (icons.icon_code(at(ICON, 0)) == c.removeprefix("weather_")).cast("int")
    return out


def _hour(step: Column) -> Column:
    return (F.col("_last") + F.make_interval(hours=step)).cast("timestamp_ntz")


def station_state(history: DataFrame, steps: int, weather: Sequence[str], forecast: DataFrame | None, target: str, past: int, profile: bool = False) -> DataFrame:
    """One row per station: newest time, newest target values, past and future weather as arrays, with ``profile`` the accumulators.

    Only the newest ``past`` rows per station are gathered; a shorter series is filled with nulls in front.
    """
    recent = last_rows(history.select("station", "time", target, *weather), past)
    latest = recent.groupBy("station").agg(
        F.max("time").alias("_last"),
        F.array_sort(F.collect_list(F.struct("time", target, *weather))).alias("_rows"),
    )
    ahead = future_weather(history, steps, forecast, weather).groupBy("station").agg(
        F.array_sort(F.collect_list(F.struct("horizon", *weather))).alias("_next")
    )
    rows, coming = F.col("_rows"), F.col("_next")

    def padded(values: Column, kind: str) -> Column:
        return F.concat(F.array_repeat(F.lit(None).cast(kind), F.greatest(F.lit(past) - F.size(rows), F.lit(0))), values)

    kinds = dict(history.dtypes)
    both = latest.join(ahead, "station")
    if profile:
        both = both.join(profile_state(history, target), "station")
    return both.select(
        "station", "_last", padded(rows[target], "double").alias("_history"),
        *[F.concat(padded(rows[w], kinds[w]), coming[w]).alias(f"_w_{w}") for w in weather],
        *(PROFILE if profile else ()),
        F.array().cast("array<double>").alias("_made"),
    )


def step_columns(
    columns: Sequence[str], stations: Sequence[str], weather: Sequence[str], target: str, past: int,
    history: Column | None = None, step: Column | None = None, profile: dict[str, Column] | None = None,
) -> dict[str, Column]:
    """The model's columns of the hour ``step`` hours after the history, in the model's order. They refer to
    the state only, so they are built once for all steps. A column that cannot be known ahead is an error."""
    history, step = F.col("_history") if history is None else history, F.col("_step") if step is None else step
    t = _hour(step)
    made = clock.calendar(t) | clock.cyclic_calendar(t) | clock.period_flags(t)
    if profile is None and profiled(columns, target):
        profile = {c: F.col(c) for c in PROFILE}
    made |= serving_features(columns, history, step, weather, past, target, profile)
    made |= {f"station_{s}": (F.col("station") == s).cast("int") for s in stations}
    unknown = [c for c in columns if c not in made]
    if unknown:
        raise ValueError(f"not known ahead of time: {', '.join(unknown)}")
    return {c: made[c].cast("double") for c in columns}


def _weather_in(history: DataFrame, weather: Sequence[str], columns: Sequence[str]) -> list[str]:
    """What is carried or forecast besides the target; the ratio of two pollutants stays at their last values."""
    extra = ["pm25", "pm10"] if RATIO in columns else []
    return [w for w in dict.fromkeys([*weather, *extra, ICON]) if w in history.columns]


def next_hour_features(
    history: DataFrame, columns: Sequence[str], stations: Sequence[str] = (), weather: Sequence[str] = tuple(WEATHER_NUMERIC),
    forecast: DataFrame | None = None, target: str = TARGET, categories: Sequence[str] = (),
) -> DataFrame:
    """What a model is served for the first hour after each station's history."""
    weather, past = _weather_in(history, weather, columns), rows_needed(columns)
    state = station_state(history, 1, weather, forecast, target, past, profiled(columns, target)).withColumn("_step", F.lit(1))
    made = step_columns(columns, stations, weather, target, past)
    sky = [weather_code(F.lit(1), past).alias("weather")] if "weather" in categories else []
    return state.select("station", _hour(F.lit(1)).alias("time"), *[v.alias(c) for c, v in made.items()], *sky)


def weather_code(step: Column, past: int) -> Column:
    """The weather category of the hour ``step`` hours ahead."""
    return icons.icon_code(F.get(F.col(f"_w_{ICON}"), step + (past - 1)))


@dataclass(frozen=True)
class LinearTerms:
    """A linear model on unscaled columns: intercept, weights and imputed means, and a weight per category level."""

    intercept: float
    weights: list[float]
    means: list[float]
    levels: dict[str, dict[str, float]]


def linear_terms(model: PipelineModel, columns: Sequence[str]) -> LinearTerms | None:
    """The terms of a pipeline of ``training.preparation`` and a linear model; None for other models."""
    last = model.stages[-1]
    scaler = next((stage for stage in model.stages if isinstance(stage, StandardScalerModel)), None)
    if scaler is None or not hasattr(last, "coefficients"):
        return None
    means = model.stages[0].surrogateDF.first().asDict()
    every, spread, centre = last.coefficients.toArray(), scaler.std.toArray(), scaler.mean.toArray()
    weights = [float(w / d) if d else 0.0 for w, d in zip(every, spread)]
    levels: dict[str, dict[str, float]] = {}
    for (column, level), w in zip(category_levels(model), every[len(columns) :], strict=True):
        levels.setdefault(column, {})[level] = float(w)
    return LinearTerms(float(last.intercept - sum(w * m for w, m in zip(weights, centre))), weights, [float(means[c]) for c in columns], levels)


def recursive_forecast(
    model: PipelineModel, history: DataFrame, columns: Sequence[str], steps: int = 24, stations: Sequence[str] = (),
    weather: Sequence[str] = tuple(WEATHER_NUMERIC), forecast: DataFrame | None = None, target: str = TARGET, cut_every: int = 6,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Forecast ``steps`` hours for all stations: each step predicts from history and earlier predictions.

    The state is one row per station with short arrays. A linear model is folded over the steps in one
    projection. For other models a step is a projection plus the model's transform, without a shuffle, and
    lineage is cut every few steps in the shared folder. ``model`` is a pipeline that starts with the
    imputer of ``training.preparation``; its means are read once. ``categories`` may be ``station`` and
    ``weather``.
    """
    if set(categories) - {"station", "weather"}:
        raise ValueError(f"not known ahead of time: {categories}")
    weather, past = _weather_in(history, weather, columns), rows_needed(columns)
    start = station_state(history, steps, weather, forecast, target, past, profiled(columns, target))
    linear = linear_terms(model, columns)
    if linear:
        state = _folded(linear, start, columns, steps, stations, weather, target, past)
    else:
        state = _stepwise(model, start, columns, steps, stations, weather, target, past, cut_every, categories)
    result = state.select("station", "_last", F.posexplode("_made").alias("_pos", "forecast"))
    return result.select("station", _hour(F.col("_pos") + 1).alias("time"), (F.col("_pos") + 1).alias("horizon"), "forecast")


def _folded(
    model: LinearTerms, start: DataFrame, columns: Sequence[str], steps: int, stations: Sequence[str], weather: Sequence[str], target: str, past: int,
) -> DataFrame:
    effects = start.sparkSession.createDataFrame(list(model.levels.get("station", {}).items()), "station STRING, _effect DOUBLE")
    sky = model.levels.get("weather", {})

    def value(made: Column, step: Column, profile: dict[str, Column] | None) -> Column:
        values = step_columns(columns, stations, weather, target, past, F.concat("_history", made), step, profile)
        terms = [F.coalesce(v, F.lit(m)) * w for v, m, w in zip(values.values(), model.means, model.weights)]
        if sky:
            terms.append(icons.lookup(sky, weather_code(step, past), F.lit(0.0)))
        total = sum(terms, F.coalesce("_effect", F.lit(0.0)) + F.lit(model.intercept))
        return F.greatest(total, F.lit(0.0))

    def add(made: Column, step: Column) -> Column:
        return F.concat(made, F.array(value(made, step, None)))

    def add_profiled(state: Column, step: Column) -> Column:
        """With accumulators: the value is bound once, then added to the forecasts and to the means of its hour and weekday."""
        profile = {c: state[c] for c in PROFILE}
        once = F.array(value(state["_made"], step, profile))
        return F.transform(once, lambda v: F.struct(F.concat(state["_made"], F.array(v)).alias("_made"), *[x.alias(c) for c, x in profile_with(profile, _hour(step), v).items()]))[0]

    joined = start.join(effects, "station", "left")
    every = F.sequence(F.lit(1), F.lit(steps))
    if profiled(columns, target):
        return joined.withColumn("_made", F.aggregate(every, F.struct("_made", *PROFILE), add_profiled)["_made"])
    return joined.withColumn("_made", F.aggregate(every, F.col("_made"), add))


def _stepwise(
    model: PipelineModel, start: DataFrame, columns: Sequence[str], steps: int, stations: Sequence[str], weather: Sequence[str], target: str, past: int, cut_every: int,
    categories: Sequence[str],
) -> DataFrame:
    imputer, rest = model.stages[0], PipelineModel(stages=model.stages[1:])
    means = imputer.surrogateDF.first().asDict()
    made = step_columns(columns, stations, weather, target, past)
    inputs = [F.coalesce(v, F.lit(float(means[c]))).alias(f"_f_{c}") for c, v in made.items()]
    if "weather" in categories:
        inputs.append(weather_code(F.col("_step"), past).alias("weather"))
    value = F.greatest(F.col("raw_prediction"), F.lit(0.0))
    moved = [
        "station", "_last", *[f"_w_{w}" for w in weather],
        F.concat(F.slice("_history", 2, past), F.array(value)).alias("_history"),
        F.concat(F.col("_made"), F.array(value)).alias("_made"), (F.col("_step") + 1).alias("_step"),
    ]
    if profiled(columns, target):
        moved += [x.alias(c) for c, x in profile_with({c: F.col(c) for c in PROFILE}, _hour(F.col("_step")), value).items()]
    state = cut_lineage(start.withColumn("_step", F.lit(1)))
    for step in range(1, steps + 1):
        state = rest.transform(state.select("*", *inputs)).select(*moved)
        if step % cut_every == 0 and step < steps:
            state = cut_lineage(state)
    return state


def holdout(df: DataFrame, steps: int, key: str = "station", time: str = "time") -> tuple[DataFrame, DataFrame]:
    """The series without its last ``steps`` rows, and those rows."""
    newest = W.partitionBy(key).orderBy(F.desc(time))
    ranked = df.withColumn("_rn", F.row_number().over(newest))
    return ranked.where(F.col("_rn") > steps).drop("_rn"), ranked.where(F.col("_rn") <= steps).drop("_rn")


def pattern_forecast(
    df: DataFrame, target: str = TARGET, steps: int = 24, recent: int = 336, enough: int = 7, rate: float = 0.1,
    key: str = "station", time: str = "time",
) -> DataFrame:
    """Recency-weighted mean of the recent rows at the same hour of day.

    With at least ``enough`` rows at that hour only rows of the same kind of day (weekday or weekend)
    count; without any row left the value of 24 hours before is used. Past rows are first summed per
    (station, hour, kind of day), so the join meets at most 48 rows per station.
    """
    past = last_rows(df.select(key, time, target), recent)
    newest = past.groupBy(key).agg(F.max(time).alias("_latest"))
    weighted = past.join(newest, key).withColumn("_w", clock.recency_weight(F.col(time), F.col("_latest"), rate))
    known = F.col(target).isNotNull()
    sums = weighted.groupBy(key, F.hour(time).alias("_hour"), (F.weekday(time) >= 5).alias("_weekend")).agg(
        F.count("*").alias("_n"),
        F.sum(F.when(known, F.col("_w") * F.col(target))).alias("_wx"),
        F.sum("_w").alias("_w"),
    )
    ahead = future_hours(df, steps, key, time).select(
        key, time, "horizon", F.hour(time).alias("_hour"), (F.weekday(time) >= 5).alias("_is_weekend")
    )
    hits = ahead.join(sums, [key, "_hour"], "left")
    same = F.col("_weekend") == F.col("_is_weekend")
    picked = hits.groupBy(key, time, "horizon").agg(
        F.sum("_n").alias("_all"), F.sum(F.when(same, F.col("_n"))).alias("_same"),
        F.sum("_wx").alias("_wx"), F.sum("_w").alias("_w"),
        F.sum(F.when(same, F.col("_wx"))).alias("_swx"), F.sum(F.when(same, F.col("_w"))).alias("_sw"),
    )
    use_same = F.col("_all") >= enough
    mean = F.when(use_same, F.col("_swx") / F.col("_sw")).otherwise(F.col("_wx") / F.col("_w"))
    yesterday = seasonal_naive(df, target, steps, key, time).select(key, time, F.col("forecast").alias("_naive"))
    return picked.join(yesterday, [key, time], "left").select(
        key, time, "horizon", F.coalesce(mean, F.col("_naive")).alias("forecast")
    )


def seasonal_naive(
    df: DataFrame, target: str = TARGET, steps: int = 24, key: str = "station", time: str = "time", season: int = 24
) -> DataFrame:
    """The value one season (24 rows) earlier, else the newest value."""
    recent = last_rows(df.select(key, time, target), season)
    newest = recent.groupBy(key).agg(F.max_by(target, time).alias("_newest"))
    order = W.partitionBy(key).orderBy(F.desc(time))
    back = recent.select(key, F.row_number().over(order).alias("_back"), F.col(target).alias("_value"))
    ahead = future_hours(df, steps, key, time).withColumn("_back", F.lit(season) - (F.col("horizon") - 1) % season)
    joined = ahead.join(back, [key, "_back"], "left").join(newest, key, "left")
    return joined.select(key, time, "horizon", F.coalesce("_value", "_newest").alias("forecast"))


def blend(recursive: DataFrame, pattern: DataFrame, weight: float = 0.7, keys: Sequence[str] = ("station", "time", "horizon")) -> DataFrame:
    a = recursive.withColumnRenamed("forecast", "recursive_forecast")
    b = pattern.withColumnRenamed("forecast", "pattern_forecast")
    mixed = F.lit(weight) * F.col("recursive_forecast") + F.lit(1.0 - weight) * F.col("pattern_forecast")
    return a.join(b, list(keys)).withColumn("forecast", mixed)


def interval_growing(df: DataFrame, mae: float | Column, z: float = 1.96, growth: float = 0.1) -> DataFrame:
    """forecast ± z·MAE·(1 + growth·horizon), floored at zero."""
    half = F.lit(z) * (mae if isinstance(mae, Column) else F.lit(float(mae))) * (1 + F.lit(growth) * F.col("horizon"))
    return df.withColumns(
        {"lower_bound": F.greatest(F.lit(0.0), F.col("forecast") - half), "upper_bound": F.col("forecast") + half}
    )


def interval_rmse(df: DataFrame, rmse: float | Column, z: float = 1.96) -> DataFrame:
    half = F.lit(z) * (rmse if isinstance(rmse, Column) else F.lit(float(rmse)))
    return df.withColumns(
        {"lower_bound": F.greatest(F.lit(0.0), F.col("forecast") - half), "upper_bound": F.col("forecast") + half}
    )


def interval_from_trees(forest: PipelineModel, df: DataFrame, columns: Sequence[str], keep: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Quantiles of the single trees' predictions of a random forest, per row."""
    from airgrid.plans.training import as_double

    prepared = as_double(df, columns)
    for stage in forest.stages[:-1]:
        prepared = stage.transform(prepared)
    rows = prepared.select(*keep, "features")
    names = []
    for i, tree in enumerate(forest.stages[-1].trees):
        names.append(f"_t{i}")
        rows = tree.setPredictionCol(names[-1]).setFeaturesCol("features").transform(rows)
    votes = F.array_sort(F.array(*names))

    def quantile(p: float) -> Column:
        position = p * (len(names) - 1)
        at = math.floor(position)
        a, b = votes[at], votes[min(at + 1, len(names) - 1)]
        return a + (b - a) * (position - at)

    return rows.select(
        *keep, F.aggregate(votes, F.lit(0.0), lambda s, x: s + x).__truediv__(len(names)).alias("forecast"),
        F.greatest(F.lit(0.0), quantile(low)).alias("lower_bound"), quantile(high).alias("upper_bound"),
    )


def horizon_summary(forecast: DataFrame) -> DataFrame:
    """Forecast counts per band and horizon, with the mean interval width."""
    from airgrid.functions.scales import category

    return forecast.groupBy(category(F.col("forecast")).alias("category")).agg(
        F.count("*").alias("n"), F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("mean_width")
    )
