"""Streams over landed reading files.

Event time is a TIMESTAMP here (``withWatermark`` rejects zone-free time). The functions that take and
return streams also work on static frames, which is how the tests compare them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.session import shared_dir
from airgrid.sources.writers import upsert_by_day

LATE = "1 hour"


def read_landed(
    spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", time: str = "time",
    files_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """Files appearing in a folder as a stream; the event time becomes an instant."""
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def hourly_means(rows: DataFrame, keys: Sequence[str], value: str = "value", time: str = "time", late: str = LATE) -> DataFrame:
    """Tumbling hourly mean; rows later than the watermark are dropped."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, "1 hour"), *keys)
        .agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("hour"), *keys, "mean_value", "n")
    )


def hourly_wide_means(
    rows: DataFrame, parameters: Sequence[str], key: str = "station", value: str = "value", parameter: str = "parameter", time: str = "time", late: str | None = None,
) -> DataFrame:
    """(key, hour as ``time``, one mean per parameter) as streaming state, for update mode: an hour comes out again, complete,
    whenever a batch adds to it. ``late`` drops hours from the state; without it the state is bounded by the calendar."""
    source = rows.withWatermark(time, late) if late else rows
    means = [F.avg(F.when(F.col(parameter) == p, F.col(value))).alias(p) for p in parameters]
    if late:
        return source.groupBy(key, F.window(time, "1 hour").alias("_hour")).agg(*means).select(key, F.col("_hour.start").alias(time), *parameters)
    return source.groupBy(key, F.date_trunc("hour", time).alias(time)).agg(*means)


def sliding_means(
    rows: DataFrame, keys: Sequence[str], value: str = "value", time: str = "time", width: str = "24 hours",
    slide: str = "1 hour", late: str = LATE,
) -> DataFrame:
    """Mean of the last ``width``, every ``slide``. Rows are combined per slide and key before they are
    copied into the windows they belong to, so a row is not multiplied by the number of windows."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, slide), *keys)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
        .groupBy(F.window(F.window_time("window"), width, slide), *keys)
        .agg((F.sum("_sum") / F.sum("_n")).alias("mean_value"), F.sum("_n").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "mean_value", "n")
    )


def distinct_readings(rows: DataFrame, keys: Sequence[str], time: str = "time", late: str = LATE) -> DataFrame:
    """Drop re-polled records; state is kept only as long as the watermark allows a repeat."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def reporting_sessions(rows: DataFrame, keys: Sequence[str], time: str = "time", gap: str = "1 hour", late: str = LATE) -> DataFrame:
    """Spans without a gap longer than ``gap``; what lies between two spans of a station is an outage."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.session_window(time, gap), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
    )


def with_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stream joined with a static table; Spark broadcasts the table when it is small enough."""
    return rows.join(table, list(keys), "left")


def run_to_table(
    stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None
) -> DataFrame:
    """Process what has landed and stop; closed results are appended to Parquet at ``out``."""
    spark = stream.sparkSession
    place = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", place).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> list[dict]:
    """Process what has landed batch by batch with ``handle(batch, batch_id)``; returns Spark's progress of each batch.

    A batch is kept while it is handled, as each further read of it would run its state anew.
    """

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    place = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", place)
        .trigger(availableNow=True).foreachBatch(kept).start()
    )
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def upsert_sink(path: str, keys: Sequence[str] = ("time", "station"), time: str = "time", order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Batch handler that merges each batch into a day-partitioned table; replaying a batch changes nothing.

    Rows of one key in a batch are folded column by column as batches are: the last known value by ``order`` wins, without
    an order the largest. Values must be final or complete so far; partial sums belong into streaming state.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(time, F.col(time).cast("timestamp_ntz"))
        rest = [c for c in rows.columns if c not in keys and c not in order]
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(c) for c in rest]
        upsert_by_day(rows.groupBy(*keys).agg(*last, *[F.max(c).alias(c) for c in order]).select(*rows.columns), path, keys, time)

    return handle


def counted(spark: SparkSession, path: str) -> DataFrame | None:
    """The counts kept by ``late_count_sink``; None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def late_count_sink(path: str, time: str = "time", late: str = LATE) -> Callable[[DataFrame, int], None]:
    """Batch handler that counts rows in time, in the overlap and too late against the batches before; a replayed batch
    replaces its own counts."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = counted(spark, path)
        before = None if seen is None else seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        counts = late_rows(batch, F.lit(before).cast("timestamp"), time, late)
        counts.withColumn("newest", batch.agg(F.max(time).alias("newest")).scalar()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def late_rows(batch: DataFrame, newest_before: Column, time: str = "time", late: str = LATE) -> DataFrame:
    """How many rows of a batch are within the overlap and how many are too late, given the newest time
    seen before the batch (null for the first batch)."""
    bound = newest_before - F.expr(f"INTERVAL {late}")
    too_late = F.coalesce(F.col(time) <= bound, F.lit(False))
    return batch.agg(
        F.count("*").alias("n"), F.count_if(too_late).alias("n_late"),
        F.count_if(F.coalesce((F.col(time) > bound) & (F.col(time) <= newest_before), F.lit(False))).alias("n_overlap"),
    )
