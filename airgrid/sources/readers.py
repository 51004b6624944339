"""Scans. Schemas are always given, so no pass over the data is spent on inference."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.functions import clock, textunits
from airgrid.operators.reshape import canonical_parameter, ensure_columns
from airgrid.session import cut_lineage
from airgrid.schema import HOURLY_FORECAST, MEASUREMENT_RECORD, STATION_DUMP

# The flat columns of a measurement file, in order.
FLAT_MEASUREMENT = [
    "location_id", "location_name", "parameter", "value", "unit", "datetime_utc", "datetime_local", "timezone",
    "latitude", "longitude", "country_iso", "is_mobile", "is_monitor", "owner_name", "provider",
]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """CSV with a header; quoted fields may hold commas, bad numbers become null."""
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **options).csv(path)


def read_station_dump(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested station files (keys are data) as one map column ``dump``: files of one object over many lines,
    or ``lines=True`` for files with one object per line, which are read in parallel."""
    return spark.read.text(path, wholetext=not lines).select(F.from_json("value", STATION_DUMP).alias("dump"))


_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_KEY = re.compile(r'"_*"\s*:\s*([\[{])')
_ENTRY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("station", pa.string()), ("data_type", pa.string()), ("parameter", pa.string()), ("entry", pa.string()), ("is_last", pa.bool_())])


def _quotes(piece: str) -> int:
    """Quotation marks that begin or end a text."""
    return piece.replace("\\\\", "").replace('\\"', "").count('"')


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files, each up to a closing brace, as entries with the keys last seen in their block; and each block's last keys."""
    now, keys, held = None, [None, None, None], ""

    def end():
        if held:
            raise ValueError(f"a text with a brace lies across two blocks of {now[0]}; read it with larger spark.sql.files.maxPartitionBytes")
        return (*now, *keys, None, True)

    for batch in batches:
        rows = []
        for piece, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != now:
                if now:
                    rows.append(end())
                now, keys, held = (file, block), [None, None, None], ""
            piece = held + piece
            held = ""
            if _quotes(piece) % 2:  # the brace was part of a text
                held = piece + "}"
                continue
            bare = _TEXT.sub(lambda m: f'"{"_" * (len(m[0]) - 2)}"', piece)  # the piece with its texts blanked out
            found = [(json.loads(piece[m.start() : bare.index('"', m.start() + 1) + 1]), m[1]) for m in _KEY.finditer(bare)]
            lists = [k for k, opened in found if opened == "["]
            maps = [k for k, opened in found if opened == "{"]
            # A station comes with its first kind; a kind or station without entries leaves nothing.
            if lists:
                if len(maps) > 1:
                    keys[0] = maps[-2]
                if maps:
                    keys[1] = maps[-1]
                keys[2] = lists[-1]
            at = bare.rfind("{")
            if at >= 0 and '"' in bare[at:] and not _KEY.search(bare, at) and not (found and found[-1][1] == "{"):
                rows.append((*now, *keys, piece[at:] + "}", False))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], names=_ENTRY.names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(end(), _ENTRY.types)], names=_ENTRY.names)


def read_station_entries(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """``station, data_type, parameter, entry``: the entries of station files, each one JSON object over any number of lines.

    Files are cut at closing braces, so a large one is read by several tasks. A block knows the keys that stand in it; what
    its first entries belong to is carried over from the blocks before, of which a file has few. An entry is a flat object
    without lists. Braces inside texts are told apart by their quotation marks. With ``joined`` the files are one object in the
    order of their names (``writers.write_station_object``), and keys are carried from file to file.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    names = ["station", "data_type", "parameter"]
    kinds = "file STRING, block LONG, " + ", ".join(f"{n} STRING" for n in names) + ", entry STRING, is_last BOOLEAN"
    rows = cut_lineage(pieces.mapInArrow(_entries, kinds))
    series = Window.orderBy("file", "block") if joined else Window.partitionBy("file").orderBy("block")  # a row per block
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where("is_last").select("file", "block", *[F.last(n, ignorenulls=True).over(before).alias(f"_{n}") for n in names])
    entries = rows.where("NOT is_last").join(F.broadcast(carried), ["file", "block"])
    return entries.select(*[F.coalesce(n, f"_{n}").alias(n) for n in names], F.from_json("entry", "MAP<STRING, STRING>").alias("entry"))


def read_measurement_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT_RECORD).json(path)


def read_hourly_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOURLY_FORECAST).json(path)


def flatten_measurements(records: DataFrame) -> DataFrame:
    """One row per measured value with the 15 flat columns; absent ones are null."""
    one = records.select("*", F.explode("results").alias("r"))
    flat = one.select(
        *[c for c in ("location_id", "location_name", "timezone", "country_iso", "owner_name", "provider") if c in records.columns],
        F.col("isMobile").alias("is_mobile"),
        F.col("isMonitor").alias("is_monitor"),
        F.col("coordinates.latitude").alias("latitude"),
        F.col("coordinates.longitude").alias("longitude"),
        canonical_parameter(F.col("r.parameter.name")).alias("parameter"),
        F.col("r.parameter.units").alias("unit"),
        F.col("r.value").alias("value"),
        clock.parse_time(F.col("r.period.datetimeFrom.utc")).alias("datetime_utc"),
        clock.parse_time(F.col("r.coverage.datetimeFrom.local")).alias("datetime_local"),
    )
    return ensure_columns(flat, FLAT_MEASUREMENT, "string").select(*FLAT_MEASUREMENT)


def flatten_hourly_forecast(records: DataFrame) -> DataFrame:
    """Epoch -> local wall time, Kelvin -> °C, first weather icon; one row per forecast hour."""
    return records.select("location", F.explode("hourly").alias("h")).select(
        clock.epoch_to_local(F.col("h.dt")).alias("time"),
        F.col("location").alias("station"),
        textunits.kelvin_to_celsius(F.col("h.temp")).alias("temperature"),
        F.col("h.pressure").alias("pressure"),
        F.col("h.humidity").alias("humidity"),
        F.col("h.wind_speed").alias("wind_speed"),
        F.col("h.wind_deg").alias("wind_direction"),
        F.try_element_at(F.col("h.weather.icon"), F.lit(1)).alias("weather_icon"),
        textunits.kelvin_to_celsius(F.col("h.dew_point")).alias("dew"),
    )


def scan(df: DataFrame, columns: Mapping[str, str] | Sequence[str], where: str | Column | None = None) -> DataFrame:
    """Filter, then keep the named columns; a mapping is source name -> output name."""
    rows = df if where is None else df.where(where)
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    return rows.select(*[F.col(f"`{src}`").alias(out) for src, out in pairs])


def read_jdbc(
    spark: SparkSession, options: Mapping[str, str], table: str, columns: Mapping[str, str],
    where: str | None = None, partition: tuple[str, str, str, int] | None = None,
) -> DataFrame:
    """Database scan; connection options come from the caller. ``partition`` is (column, lower, upper, n)
    and makes n range queries run in parallel."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition:
        column, lower, upper, n = partition
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", n)
        )
    return scan(reader.load(), columns, where)


def run_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None, **args: object) -> DataFrame:
    """Run one SQL text with named parameters (``:name``) over the given frames as temporary views."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text, args=args or None)


def run_sql_file(spark: SparkSession, path: str, **args: object) -> DataFrame | None:
    """Run the statements of a file (split at ``;`` line ends); the last result is returned."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=False).collect())
    result = None
    for statement in (s.strip() for s in text.split(";\n")):
        if statement.strip(";"):
            result = spark.sql(statement.strip(";"), args=args or None)
    return result
