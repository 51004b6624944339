"""Incremental merge of three sources into one row per (time, station)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.functions.clock import floor_to, utc_to_local
from airgrid.functions.scales import score
from airgrid.functions.textunits import to_number
from airgrid.operators import fill, joins
from airgrid.operators.buckets import hourly_weather
from airgrid.operators.dedup import keep_most_complete
from airgrid.operators.filters import incremental_bounds, newer_than
from airgrid.operators.grid import joint_hours
from airgrid.session import cut_lineage
from airgrid.schema import KEY, POLLUTANTS, WEATHER, WEATHER_NUMERIC


def carry_raw(df: DataFrame, columns: list[str], order: list[str], key: str = "station", time: str = "time", parts: int | None = None) -> DataFrame:
    """Forward then backward fill of raw rows per key, as a segmented scan.

    Rows are dealt into ``parts`` ranges of (key, time, order) of about equal size, so neither a busy key nor a busy minute lies in
    one task; each range is filled forward in one pass over its sorted rows and written. What a range passes on, the first and
    last known value of each of its keys, is carried over the ranges and added in a second pass. ``order`` makes
    rows of one time unique. Rows without a key or a time have no place in a series: they stay as they are.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lost = F.col(key).isNull() | F.col(time).isNull()
    sort = [F.col(c) for c in (key, time, *order)]
    filled = {c: f"_filled_{c}" for c in columns}
    # Rows without a place are spread by a hash, so that many of them fill several ranges too.
    spread = F.when(lost, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(4 * n)) + 1).otherwise(0)
    ranged = df.withColumn("_lost", spread).repartitionByRange(n, "_lost", *sort).sortWithinPartitions("_lost", *sort)
    scanned = cut_lineage(ranged.mapInArrow(partial(_fill_forward, columns, key), _scanned_schema(df, columns)))
    known = [F.when(F.col(f).isNotNull(), F.struct(time, *order)) for f in filled.values()]
    ends = scanned.where("_lost = 0").groupBy(key, "_part").agg(
        *[F.min_by(f, k).alias(f"_first_{c}") for (c, f), k in zip(filled.items(), known)],
        *[F.max_by(f, k).alias(f"_last_{c}") for (c, f), k in zip(filled.items(), known)],
    )
    back = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(key).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, 0)
    passed = ends.select(
        key, "_part",
        *[F.last(f"_last_{c}", ignorenulls=True).over(back).alias(f"_in_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(ahead).alias(f"_out_{c}") for c in columns],
    )
    joined = scanned.join(passed, [key, "_part"], "left")
    value = {c: F.when(F.col("_lost") == 0, F.coalesce(filled[c], f"_in_{c}", f"_out_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(value).select(*[f"`{c}`" for c in df.columns])


def _scanned_schema(df: DataFrame, columns: list[str]) -> T.StructType:
    added = [T.StructField("_lost", T.LongType()), *[T.StructField(f"_filled_{c}", df.schema[c].dataType) for c in columns], T.StructField("_part", T.IntegerType())]
    return T.StructType([*df.schema.fields, *added])


def _fill_forward(columns: list[str], key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the last known value of the key in this task's sorted rows, batch by batch; holds one value per column between them."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_key, carried = None, {}
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        keys = batch.column(key)
        lost = batch.column("_lost").to_numpy(zero_copy_only=False) > 0
        new = np.ones(n, bool)
        new[1:] = pc.fill_null(pc.not_equal(keys.slice(0, n - 1), keys.slice(1)), True).to_numpy(zero_copy_only=False)
        new |= lost
        goes_on = not lost[0] and last_key is not None and keys[0].as_py() == last_key
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        arrays = list(batch.columns)
        for c in columns:
            values = batch.column(c)
            known = pc.is_valid(values).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(known, np.arange(n), -1))
            none = at < start
            # The value carried from the batch before stands in front of the column.
            front = carried.get(c) if goes_on else None
            source = pa.concat_arrays([pa.array([front], values.type), values])
            take = np.where(none, 0, at + 1)
            arrays.append(source.take(pa.array(take, mask=none & ((start > 0) | lost))))
        last_key = None if lost[-1] else keys[n - 1].as_py()
        carried = {c: arrays[len(batch.columns) + i][n - 1].as_py() for i, c in enumerate(columns)}
        arrays.append(pa.array(np.full(n, part), pa.int32()))
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *[f"_filled_{c}" for c in columns], "_part"])


def score_then_average(raw: DataFrame, time: str = "time", scale: str = "rounded") -> DataFrame:
    """Score every raw value, then average the scores per (time, station) hour."""
    scored = raw.withColumns({p: score(p, p, scale) for p in POLLUTANTS})
    return scored.groupBy(floor_to(F.col(time)).alias("time"), "station").agg(*[F.avg(p).alias(p) for p in POLLUTANTS])


def average_then_score(hourly: DataFrame, scale: str = "rounded") -> DataFrame:
    return hourly.withColumns({p: score(p, p, scale) for p in POLLUTANTS})


def raw_source_hourly(raw: DataFrame, lookup: DataFrame, utc_time: str = "utc_time", place: str = "location_name") -> DataFrame:
    """Concentrations in UTC under feed names -> hourly scores in local time under station names."""
    renamed = joins.map_names(raw, lookup, place).withColumnRenamed(place, "station")
    numeric = renamed.withColumns({p: to_number(F.col(p).cast("string")) if dict(raw.dtypes)[p] == "string" else F.col(p) for p in POLLUTANTS})
    return score_then_average(numeric.withColumn("time", utc_to_local(F.col(utc_time))))


def weather_source_hourly(weather: DataFrame, order: list[str]) -> DataFrame:
    """Fill raw weather per station, then hourly means and the most common icon."""
    filled = carry_raw(fill.fill_mean_mode(weather, [], ["weather_icon"]), WEATHER_NUMERIC, order)
    return hourly_weather(filled, [*WEATHER_NUMERIC, *POLLUTANTS], "weather_icon")


def city_weather(hub: DataFrame, readings: DataFrame) -> DataFrame:
    """One weather row for every hour of the joint time range (bounded by the calendar)."""
    hours = joint_hours(readings, hub)
    return fill.fill_weather(hours.join(hub.select("time", *WEATHER), "time", "left"), WEATHER_NUMERIC, "weather_icon")


def merge_sources(
    scored: DataFrame, raw: DataFrame, weather: DataFrame, lookup: DataFrame, hub: str,
    weather_order: list[str], merged: DataFrame | None = None,
) -> DataFrame:
    """Merge the scored readings, the raw UTC concentrations and the hub's weather.

    ``scored``: (time, station, six index columns). ``raw``: (utc_time, location_name, six
    concentrations). ``weather``: raw rows of (time, station, six pollutants, weather). With ``merged``
    given only rows newer than its newest hour (with the overlaps) are processed.
    """
    if merged is not None:
        bounds = incremental_bounds(merged)
        scored = newer_than(scored, bounds["readings"])
        weather = newer_than(weather, bounds["weather"])
        raw = newer_than(raw, bounds["utc"], "utc_time")
    readings = scored.select(floor_to(F.col("time")).alias("time"), "station", *POLLUTANTS)
    # One station's hours: small however large the sources are, and used three times below, so it is
    # written once instead of being planned three times.
    hub_hourly = cut_lineage(weather_source_hourly(weather.where(F.col("station") == hub), weather_order))
    with_weather = joins.with_city_weather(readings, city_weather(hub_hourly, readings))
    hub_rows = hub_hourly if merged is None else newer_than(hub_hourly, bounds["readings"])
    rows = with_weather.withColumn("_source", F.lit(0)).unionByName(hub_rows.withColumn("_source", F.lit(1)))
    unique = keep_most_complete(rows, KEY, "_source").drop("_source")
    return joins.reconcile(unique, raw_source_hourly(raw, lookup), KEY, POLLUTANTS)


def stat_else_published(rows: DataFrame, order: list[str]) -> DataFrame:
    """(station, time, data_type, parameter, value) -> one row per (station, time): the index computed
    from the measured value where there is one, else the published index; plus overall and category."""
    from airgrid.functions.scales import category, overall

    def first(kind: str, p: str) -> Column:
        hit = (F.col("data_type") == kind) & (F.col("parameter") == p) & F.col("value").isNotNull()
        return F.min_by("value", F.when(hit, F.struct(*order)))

    wide = rows.groupBy("station", "time").agg(
        *[first("stat", p).alias(f"_stat_{p}") for p in POLLUTANTS], *[first("aqi", p).alias(f"_aqi_{p}") for p in POLLUTANTS]
    )
    scored = wide.select(
        "station", "time",
        *[F.coalesce(score(f"_stat_{p}", p), F.col(f"_aqi_{p}")).alias(f"aqi_{p}") for p in POLLUTANTS],
    ).withColumn("overall_aqi", overall([F.col(f"aqi_{p}") for p in POLLUTANTS]))
    return scored.withColumn("aqi_category", category(F.col("overall_aqi")))
