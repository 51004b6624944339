"""Tables as numbered snapshots.

A write puts its rows into a folder of its own, ``data/commit=<id>`` (by day: ``/date=<day>`` below it), which nobody reads yet.
Then a manifest ``log/<number>.json`` is created, which holds the schema and the folders that make up the table; a
manifest that is there already is never replaced. So a reader sees the table before a write or after it, whatever happens in
between, and two writers cannot publish the same number: the later one redoes its work on the newer table.

Folders stand for days, not files, so a manifest grows with the calendar and the writes since the last ``compact``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.operators.reshape import widen

DAY, COMMIT = "date", "commit"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a time
TRIES = 10


class Overtaken(Exception):
    """Another writer has published this number."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: T.StructType
    time: str | None  # the column whose days are folders; None: no such folders
    parts: tuple[tuple[str, str], ...]  # (commit, day); the day is empty where there are no folders of days

    def days(self) -> set[str]:
        return {d for _, d in self.parts}


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def _children(spark: SparkSession, place: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    path = _path(spark, place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _children(spark, f"{path}/log") if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest snapshot, or that of a number; None where there is no table."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    manifest = _path(spark, f"{path}/log/{version:012d}.json")
    stream = manifest.getFileSystem(spark._jsc.hadoopConfiguration()).open(manifest)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(version, T.StructType.fromJson(said["schema"]), said["time"], tuple((c, d) for c, days in said["parts"].items() for d in days))


def publish(spark: SparkSession, path: str, new: Snapshot) -> None:
    """Create the manifest: written under a passing name and renamed, which fails if the number is taken."""
    parts: dict[str, list[str]] = {}
    for commit, day in new.parts:
        parts.setdefault(commit, []).append(day)
    text = json.dumps({"schema": json.loads(new.schema.json()), "time": new.time, "parts": parts})
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    passing, target = _path(spark, f"{path}/log/.{uuid.uuid4().hex}"), _path(spark, f"{path}/log/{new.version:012d}.json")
    out = passing.getFileSystem(conf).create(passing, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(passing, target, plain)
    except Py4JJavaError as error:
        context.delete(passing, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise Overtaken(str(new.version)) from None
        raise


def _leaf(path: str, commit: str, day: str) -> str:
    return f"{path}/data/{COMMIT}={commit}" + (f"/{DAY}={day}" if day else "")


def read(spark: SparkSession, path: str, version: int | None = None, days: Iterable[str] | None = None) -> DataFrame | None:
    """The table as of its newest snapshot or of ``version``, with all columns it has had; None where there is no table.

    ``days`` (ISO texts, ``NO_DAY`` for rows without a time) leaves the folders of other days alone. Tables by day have a
    column ``date``, on which Spark prunes too.
    """
    now = snapshot(spark, path, version)
    return None if now is None else rows_of(spark, path, now, days)


def rows_of(spark: SparkSession, path: str, now: Snapshot, days: Iterable[str] | None = None) -> DataFrame:
    wanted = None if days is None else set(days)
    leaves = [_leaf(path, c, d) for c, d in now.parts if wanted is None or d in wanted]
    schema = T.StructType([*now.schema.fields, *([T.StructField(DAY, T.DateType())] if now.time else [])])
    if not leaves:
        return spark.createDataFrame([], schema)
    known = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
    return spark.read.schema(known).option("basePath", f"{path}/data").parquet(*leaves).drop(COMMIT).select(*[f"`{f.name}`" for f in schema.fields])


def _write(spark: SparkSession, path: str, rows: DataFrame, time: str | None) -> tuple[tuple[str, str], ...]:
    """Rows into a folder of their own; which parts it has. The rebalance hint joins small writes and splits a large day."""
    commit = uuid.uuid4().hex
    place = _leaf(path, commit, "")
    if time:
        rows.withColumn(DAY, F.to_date(f"`{time}`")).hint("rebalance", DAY).write.partitionBy(DAY).parquet(place)
        return tuple((commit, n.split("=", 1)[1]) for n in sorted(_children(spark, place)) if n.startswith(f"{DAY}="))
    rows.write.parquet(place)
    return ((commit, ""),)


# What a change makes of a table: the rows to write, in the columns of the new schema, and the days they replace (None: no day, all: every day).
Change = Callable[[DataFrame, Snapshot | None], tuple[DataFrame, set[str] | None]]


def change(df: DataFrame, path: str, plan: Change, time: str | None = "time") -> Snapshot:
    """Carries out ``plan`` and publishes the next snapshot; if another writer was faster, again on the newer one."""
    spark = df.sparkSession
    for _ in range(TRIES):
        old = snapshot(spark, path)
        by = old.time if old else time
        rows, replaced = plan(df, old)
        parts = _write(spark, path, rows, by)
        kept = tuple(p for p in old.parts if replaced is None or p[1] not in replaced) if old else ()
        new = Snapshot(old.version + 1 if old else 0, rows.schema, by, kept + parts)
        try:
            publish(spark, path, new)
            return new
        except Overtaken:
            continue
    raise Overtaken(f"{path}: {TRIES} other writers were faster")


def fitted(df: DataFrame, old: Snapshot | None) -> DataFrame:
    """Rows in the table's columns and types; columns it does not know are added, those the rows lack are null."""
    return df if old is None else widen(old.schema, df)


def days_in(df: DataFrame, time: str) -> set[str]:
    """The days of the rows, bounded by the calendar."""
    found = df.select(F.to_date(f"`{time}`").cast("string").alias("d")).distinct().collect()
    return {r.d or NO_DAY for r in found}


def append(df: DataFrame, path: str, time: str | None = "time") -> Snapshot:
    return change(df, path, lambda rows, old: (fitted(rows, old), None), time)


def replace(df: DataFrame, path: str, time: str | None = "time") -> Snapshot:
    """Full refresh; the table's columns become those of the rows. Older snapshots stay readable."""
    return change(df, path, lambda rows, old: (rows, old.days() if old else None), time)


def merge(df: DataFrame, path: str, combine: Callable[[DataFrame | None, DataFrame], DataFrame], keys: Sequence[str], time: str | None = "time") -> Snapshot:
    """Replaces what the rows touch by ``combine(stored rows, new rows)``, both in the same columns.

    Where the time is a key, rows of other days cannot be touched: only the days of the new rows are read and written.
    """
    spark = df.sparkSession

    def plan(rows: DataFrame, old: Snapshot | None):
        fresh = fitted(rows, old)
        if old is None:
            return combine(None, fresh), None
        touched = days_in(fresh, old.time) & old.days() if old.time and old.time in keys else old.days()
        before = rows_of(spark, path, old, touched)
        before = widen(fresh.schema, before.drop(DAY) if old.time else before)
        return combine(before, fresh), touched

    return change(df, path, plan, time)


def insert(df: DataFrame, path: str, fresh_rows: Callable[[DataFrame | None, DataFrame], DataFrame], keys: Sequence[str], time: str | None = "time") -> Snapshot:
    """Adds ``fresh_rows(stored rows, new rows)`` and rewrites nothing."""
    spark = df.sparkSession

    def plan(rows: DataFrame, old: Snapshot | None):
        fresh = fitted(rows, old)
        if old is None:
            return fresh_rows(None, fresh), None
        days = days_in(fresh, old.time) if old.time and old.time in keys else None
        return fresh_rows(rows_of(spark, path, old, days), fresh), None

    return change(df, path, plan, time)


def compact(spark: SparkSession, path: str) -> Snapshot | None:
    """Rewrites the days that lie in several folders, so that each is one folder again."""
    now = snapshot(spark, path)
    if now is None:
        return None
    several = {d for d in now.days() if sum(1 for _, x in now.parts if x == d) > 1}
    if not several:
        return now
    none = spark.createDataFrame([], now.schema)

    def plan(_: DataFrame, old: Snapshot | None):
        rows = rows_of(spark, path, old, several & old.days())
        return (rows.drop(DAY) if old.time else rows), several

    return change(none, path, plan, now.time)


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Deletes the manifests before the last ``keep`` and the folders none of these names, and returns the folders.

    Not to be run while a write is under way, as its folder is not named yet.
    """
    known = versions(spark, path)
    files = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    needed = {c for v in known[-keep:] for c, _ in snapshot(spark, path, v).parts}
    for v in known[:-keep]:
        files.delete(_path(spark, f"{path}/log/{v:012d}.json"), False)
    gone = [n for n in _children(spark, f"{path}/data") if n.startswith(f"{COMMIT}=") and n.split("=", 1)[1] not in needed]
    for n in gone:
        files.delete(_path(spark, f"{path}/data/{n}"), True)
    return gone


def history(spark: SparkSession, path: str) -> DataFrame:
    """``version, n_columns, n_days, n_folders`` of every snapshot that is still there."""
    rows = [(v, len(s.schema), len(s.days()), len(s.parts)) for v in versions(spark, path) for s in (snapshot(spark, path, v),)]
    return spark.createDataFrame(rows, "version LONG, n_columns INT, n_days INT, n_folders INT")
