"""Streaming jobs over the event files, run until everything landed is processed.

Windows stay open until the watermark (newest event minus one hour) passes their end, so the
reference SQL keeps only closed windows.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.plans import feeds
from airgrid.plans.feeds import MEASURED
from airgrid.queries import sqlbase as s
from airgrid.queries.registry import query
from airgrid.schema import fields
from airgrid.session import shared_dir
from airgrid.sources.writers import stored
from airgrid.streaming import jobs, keyed

EVENTS = fields(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=T.StringType(), value=T.DoubleType(), props=T.StringType())


def landed(spark, d):
    """The event files as a stream of readings. The pattern matches just that file or folder; a plain
    path would have to be a folder."""
    return readings_of(jobs.read_landed(spark, f"{d}/events.parque[t]", EVENTS, "parquet", time="ts"))


def readings_of(rows):
    return rows.select(
        "event_id", feeds.station_of(F.col("user_id")).alias("station"), F.col("ts").alias("time"),
        feeds.parameter_of(F.col("event_type")).alias("parameter"), "value",
    )


PARTS = 3
# The third of the time range a row lies in; every 40th event comes one part late.
_PART = f"(epoch_us(ts) - lo) * {PARTS} // (hi - lo + 1)"


FILE_ROWS = 1_000_000


def landed_in_parts(spark, d, late_every: int | None = None):
    """The events as files that land part by part, in order of time and cut inside an hour; a batch reads one part.

    Every part has as many files as the others (empty ones, where its rows are too few), so a batch is a part at any size.
    """
    events = spark.read.schema(EVENTS).parquet(f"{d}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi, n = events.agg(F.min(at), F.max(at), F.count("*")).first()
    part = F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {lo}) * {PARTS} div ({hi} - {lo} + 1)") if lo is not None else F.lit(0)
    if late_every:
        part = F.least(part + (F.col("event_id") % late_every == 0).cast("int"), F.lit(PARTS - 1))
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    files = max(1, -(-n // (PARTS * FILE_ROWS)))
    none = events.where("false").coalesce(1)
    for k in range(PARTS):
        events.where(part == k).repartition(files).write.mode("append").parquet(folder)
        for _ in range(files * (k + 1) - len(spark.read.schema(EVENTS).parquet(folder).inputFiles())):
            none.write.mode("append").parquet(folder)
    rows = jobs.read_landed(spark, folder, EVENTS, "parquet", time="ts", files_per_trigger=files)
    return readings_of(rows)


def out_dir(spark) -> str:
    return f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"


def zone_free(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_CLOSED = "(SELECT max(time) FROM readings) - INTERVAL 1 HOUR"


@query(
    "stream_hourly", "N1 N2",
    s.cte("readings") + "SELECT date_trunc('hour', time) AS hour, station, parameter, avg(value) AS mean_value, count(*) AS n FROM readings GROUP BY 1, 2, 3 "
    f"HAVING date_trunc('hour', time) + INTERVAL 1 HOUR <= {_CLOSED}", "mean_value",
)
def _(spark, d):
    result = jobs.run_to_table(jobs.hourly_means(landed(spark, d), ["station", "parameter"]), out_dir(spark))
    return zone_free(result, "hour")


@query(
    "stream_sliding", "N4",
    s.cte("readings", h="SELECT date_trunc('hour', time) AS hour, station, sum(value) AS t, count(*) AS c FROM readings GROUP BY 1, 2",
          w="SELECT hour + INTERVAL 1 HOUR - (range * INTERVAL 1 HOUR) AS window_start, station, t, c FROM h, range(1, 25)")
    + "SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, station, sum(t) / sum(c) AS mean_value, CAST(sum(c) AS BIGINT) AS n FROM w GROUP BY 1, 2, 3 "
    f"HAVING window_start + INTERVAL 24 HOUR <= {_CLOSED}", "mean_value",
)
def _(spark, d):
    result = jobs.run_to_table(jobs.sliding_means(landed(spark, d), ["station"]), out_dir(spark))
    return zone_free(result, "window_start", "window_end")


@query("stream_dedup", "N3 F7", s.cte("readings") + "SELECT station, parameter, count(*) AS n, sum(value) AS total FROM readings GROUP BY 1, 2", "total")
def _(spark, d):
    """Every file is polled twice; each reading must come out once, with two hours of state."""
    once = landed_in_parts(spark, d)
    kept = jobs.run_to_table(jobs.distinct_readings(once.unionByName(once), ["event_id"], late="2 hours"), out_dir(spark))
    return kept.groupBy("station", "parameter").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "stream_sessions", "N5 D22",
    s.cte("readings", g="SELECT station, time, CASE WHEN time >= lag(time) OVER (PARTITION BY station ORDER BY time) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS cut FROM readings",
          n="SELECT station, time, sum(cut) OVER (PARTITION BY station ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g")
    + "SELECT station, min(time) AS session_start, max(time) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM n GROUP BY station, sid "
    f"HAVING max(time) + INTERVAL 1 HOUR <= {_CLOSED}",
)
def _(spark, d):
    result = jobs.run_to_table(jobs.reporting_sessions(landed(spark, d), ["station"]), out_dir(spark))
    return zone_free(result, "session_start", "session_end")


@query(
    "stream_latest", "N8 E11",
    s.cte("readings", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC, value DESC) AS rn FROM readings") + "SELECT station, time, value FROM r WHERE rn = 1",
)
def _(spark, d):
    """Keyed state over three batches, then all of them replayed into the same table."""
    table = out_dir(spark)
    stream = landed_in_parts(spark, d)
    with keyed.keyed_state(spark):
        for _ in range(2):
            jobs.run_batches(keyed.latest_state(stream), keyed.latest_sink(table), mode="update")
    return zone_free(stored(spark, table).select("station", "time", "value"), "time")


@query("stream_upsert", "N6 A12", s.cte("hourly") + "SELECT station, time, pm25, pm10 FROM hourly", "pm25 pm10")
def _(spark, d):
    """Hourly means as complete results of streaming state, merged into a day-partitioned table over several batches."""
    table = out_dir(spark)
    jobs.run_batches(jobs.hourly_wide_means(landed_in_parts(spark, d), ["pm25", "pm10"]), jobs.upsert_sink(table), mode="update")
    return stored(spark, table).select("station", "time", "pm25", "pm10")


@query("stream_final_hours", "N6 N7 A12", s.cte("hourly") + f"SELECT station, time, {', '.join(MEASURED)} FROM hourly", " ".join(MEASURED))
def _(spark, d):
    """Hours close and leave the state; every 40th reading comes a batch late, long after that, and still counts."""
    table = out_dir(spark)
    stream = landed_in_parts(spark, d, late_every=40)
    with keyed.keyed_state(spark):
        for _ in range(2):
            jobs.run_batches(keyed.hourly_sums(stream, MEASURED), keyed.hourly_sink(table), mode="update")
    return keyed.hourly_table(spark, table, MEASURED)


@query(
    "stream_static_join", "N9 C1",
    s.cte("readings", "wx") + "SELECT r.station, r.parameter, count(*) AS n, avg(humidity) AS mean_humidity FROM readings r LEFT JOIN wx w ON r.station = w.station AND date_trunc('hour', r.time) = w.time GROUP BY 1, 2",
    "mean_humidity",
)
def _(spark, d):
    hourly = feeds.hourly_weather_station(spark, d).select("station", F.col("time").cast("timestamp").alias("hour"), "humidity")
    stream = landed(spark, d).withColumn("hour", F.date_trunc("hour", "time"))
    joined = jobs.run_to_table(jobs.with_lookup(stream, hourly, ["station", "hour"]), out_dir(spark))
    return joined.groupBy("station", "parameter").agg(F.count("*").alias("n"), F.avg("humidity").alias("mean_humidity"))


@query(
    "stream_late_rows", "N7 S18",
    f"WITH range AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), "
    f"p AS (SELECT ts AS time, least({_PART} + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS batch_id FROM events, range), "
    "b AS (SELECT batch_id, max(time) AS newest FROM p GROUP BY 1), "
    "s AS (SELECT batch_id, newest, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b) "
    "SELECT CAST(p.batch_id AS BIGINT) AS batch_id, count(*) AS n, count(*) FILTER (time <= seen - INTERVAL 1 HOUR) AS n_late, "
    "count(*) FILTER (time > seen - INTERVAL 1 HOUR AND time <= seen) AS n_overlap, max(newest) AS newest FROM p JOIN s ON p.batch_id = s.batch_id GROUP BY 1",
)
def _(spark, d):
    """Per batch: all rows, those too late and those in the overlap, against the newest time seen before."""
    table = out_dir(spark)
    jobs.run_batches(landed_in_parts(spark, d, late_every=40), jobs.late_count_sink(table))
    return zone_free(jobs.counted(spark, table), "newest").withColumn("batch_id", F.col("batch_id").cast("long"))
