"""Sources and sinks: nested feeds, CSV, and tables written to the shared folder."""

import uuid

from pyspark.sql import functions as F

from airgrid.functions.clock import epoch_seconds, floor_to
from airgrid.operators import reshape
from airgrid.plans import feeds, forecasting
from airgrid.queries import sqlbase as s
from airgrid.queries.gaps import target
from airgrid.queries.merging import _HALVES, halves
from airgrid.queries.registry import query
from airgrid.schema import KEY, fields
from airgrid.session import shared_dir
from airgrid.sources import readers, snapshots, writers
from pyspark.sql import types as T


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "station_dump_rows", "A2 G3 B6",
    s.cte("readings") + "SELECT station, CASE WHEN parameter IN ('pm25', 'pm10') THEN 'stat' ELSE 'aqi' END AS data_type, parameter, date_trunc('second', time) AS time, value FROM readings",
)
def _(spark, d):
    """Each reading landed as the nested JSON a feed would send, with both spellings of the value, read and flattened."""
    r = feeds.readings(spark, d)
    kind = F.when(F.col("parameter").isin("pm25", "pm10"), "stat").otherwise("aqi")
    loud = F.when(F.col("parameter") == "pm25", "PM2_5").otherwise(F.upper("parameter"))
    spelled = F.when(F.col("event_id") % 2 == 0, "value").otherwise(loud)
    entry = F.create_map(F.lit("time"), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), spelled, F.col("value").cast("string"))
    out = place(spark, "dump")
    r.select(F.to_json(F.create_map("station", F.create_map(kind, F.create_map(loud, F.array(entry))))).alias("value")).write.text(out)
    return reshape.station_dump_rows(readers.read_station_dump(spark, out, lines=True))


@query(
    "landed_object_rows", "A2 G3",
    s.cte("readings") + "SELECT station, CASE WHEN parameter IN ('pm25', 'pm10') THEN 'stat' ELSE 'aqi' END AS data_type, parameter, date_trunc('second', time) AS time, value FROM readings",
)
def _(spark, d):
    """All readings landed as one JSON object over many lines, in files that follow one another, read back by ranges of them."""
    r = feeds.readings(spark, d).withColumn("kind", F.when(F.col("parameter").isin("pm25", "pm10"), "stat").otherwise("aqi"))
    out = place(spark, "object")
    writers.write_station_object(r, out, ["station", "kind", "parameter"], ["time", "event_id"])
    return reshape.station_entry_rows(readers.read_station_entries(spark, out, joined=True))


@query(
    "flatten_measurements", "A3 B1 B20",
    s.cte("readings") + "SELECT event_id AS location_id, station AS location_name, parameter, value, 'ug' AS unit, date_trunc('second', time) AS datetime_utc, "
    "date_trunc('second', time) AS datetime_local, 21e0 AS latitude, 105e0 AS longitude FROM readings",
)
def _(spark, d):
    r = feeds.readings(spark, d)
    utc = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    local = F.concat(F.date_format(F.col("time") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))
    result = F.struct(
        F.col("value"), F.struct(F.upper("parameter").alias("name"), F.lit("ug").alias("units")).alias("parameter"),
        F.struct(F.struct(utc.alias("utc")).alias("datetimeFrom")).alias("period"),
        F.struct(F.struct(local.alias("local")).alias("datetimeFrom")).alias("coverage"),
    )
    records = r.select(
        F.col("event_id").alias("location_id"), F.col("station").alias("location_name"), F.lit(True).alias("isMonitor"), F.lit(False).alias("isMobile"),
        F.struct(F.lit(21.0).alias("latitude"), F.lit(105.0).alias("longitude")).alias("coordinates"), F.array(result).alias("results"),
    )
    out = place(spark, "records")
    records.write.json(out)
    flat = readers.flatten_measurements(readers.read_measurement_records(spark, out))
    return flat.select(
        "location_id", "location_name", "parameter", "value", "unit", F.col("datetime_utc").cast("timestamp_ntz").alias("datetime_utc"),
        F.col("datetime_local").cast("timestamp_ntz").alias("datetime_local"), "latitude", "longitude",
    )


@query(
    "flatten_hourly_forecast", "A4 I17 I18",
    s.cte("weather") + "SELECT date_trunc('second', time) + INTERVAL 7 HOUR AS time, station, round_even((humidity + 250e0) - 273.15e0, 2) AS temperature, wind_speed, weather_icon FROM weather",
    "temperature",
)
def _(spark, d):
    w = feeds.weather(spark, d)
    hour = F.struct(
        epoch_seconds(F.col("time")).alias("dt"), (F.col("humidity") + 250.0).alias("temp"), (F.col("humidity") + 250.0).alias("dew_point"), F.col("pressure"),
        F.col("humidity"), F.col("wind_speed"), F.col("wind_direction").alias("wind_deg"), F.array(F.struct(F.col("weather_icon").alias("icon"))).alias("weather"),
    )
    records = w.select(F.col("station").alias("location"), F.array(hour).alias("hourly"))
    out = place(spark, "hourly")
    records.write.json(out)
    return readers.flatten_hourly_forecast(readers.read_hourly_forecast(spark, out)).select("time", "station", "temperature", "wind_speed", "weather_icon")


@query("csv_round_trip", "A1 A7", s.cte("readings") + "SELECT event_id, station, time, parameter, value FROM readings")
def _(spark, d):
    out = place(spark, "csv")
    writers.append_csv(feeds.readings(spark, d), out)
    kinds = fields(event_id=T.LongType(), station=T.StringType(), time=T.TimestampNTZType(), parameter=T.StringType(), value=T.DoubleType())
    return readers.read_csv(spark, out, kinds, timestampNTZFormat=writers.CSV_TIME)


_UPSERTED = (
    "SELECT coalesce(o.station, n.station) AS station, coalesce(o.time, n.time) AS time, coalesce(n.pm25, o.pm25) AS pm25, coalesce(n.pm10, o.pm10) AS pm10, "
    "coalesce(n.no2, o.no2) AS no2 FROM old o FULL JOIN new n ON o.station = n.station AND o.time = n.time"
)


@query("stored_upsert", "A10 A12", s.cte("hourly", **_HALVES) + _UPSERTED.replace(" FROM old", ", n.pm25 / 2 AS pm1 FROM old"), "pm25 pm10 no2 pm1")
def _(spark, d):
    """The day-partitioned table after two rounds of the same update, which adds a column (the second changes nothing)."""
    old, new = halves(spark, d)
    out = place(spark, "table")
    writers.write_by_day(old, out)
    update = new.withColumn("pm1", F.col("pm25") / 2)
    writers.upsert_by_day(update, out, KEY)
    writers.upsert_by_day(update, out, KEY)
    return writers.stored(spark, out).select("station", "time", "pm25", "pm10", "no2", "pm1")


@query(
    "stored_keep_last", "A13 A15",
    s.cte("hourly", **_HALVES) + "SELECT *, pm25 / 2 AS pm1 FROM new UNION ALL SELECT o.*, NULL FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.station = o.station AND n.time = o.time)",
    "pm25 pm10 no2 pm1",
)
def _(spark, d):
    """Whole rows replaced, by an update that adds a column."""
    old, new = halves(spark, d)
    out = place(spark, "table")
    writers.write_by_day(old, out)
    return writers.upsert_keep_last(new.withColumn("pm1", F.col("pm25") / 2), out, KEY)


@query(
    "stored_insert_new", "A14 C5",
    s.cte("hourly", **_HALVES) + "SELECT * FROM old UNION ALL SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.station = o.station AND n.time = o.time)",
    "pm25 pm10 no2",
)
def _(spark, d):
    old, new = halves(spark, d)
    out = place(spark, "table")
    writers.insert_new(old, out, KEY)
    writers.insert_new(new, out, KEY)
    return writers.stored(spark, out)


# The second frame knows neither pm25 nor pm10 and adds no2 and a new column; the third knows pm10 only.
_FRAMES = {
    **_HALVES,
    "wide": "SELECT station, time, no2, no2 / 2 AS pm1 FROM new",
    "narrow": "SELECT station, time + INTERVAL 30 DAY AS time, pm10 FROM old",
}
_KNOWN = "station, time, pm25, pm10, no2, pm1"


def frames(spark, d):
    """An old table, a frame with other columns an hour later, and one with fewer columns on later days."""
    old, new = halves(spark, d)
    wide = new.select("station", "time", "no2", (F.col("no2") / 2).alias("pm1"))
    narrow = old.select("station", (F.col("time") + F.expr("INTERVAL 30 DAYS")).alias("time"), "pm10")
    return old.drop("no2"), wide, narrow


def known(df):
    return df.select("station", "time", "pm25", "pm10", "no2", "pm1")


_LACKING = "CAST(NULL AS DOUBLE)"


@query(
    "snapshot_append", "A10 A11",
    s.cte("hourly", **_FRAMES) + f"SELECT station, time, pm25, pm10, {_LACKING} AS no2, {_LACKING} AS pm1 FROM old UNION ALL SELECT station, time, {_LACKING}, {_LACKING}, no2, pm1 FROM wide "
    f"UNION ALL SELECT station, time, {_LACKING}, pm10, {_LACKING}, {_LACKING} FROM narrow", "pm25 pm10 no2 pm1",
)
def _(spark, d):
    """Appends to a table by day, of frames with more and with fewer columns."""
    out = place(spark, "table")
    for frame in frames(spark, d):
        writers.write_by_day(frame, out)
    return known(writers.stored(spark, out))


@query(
    "snapshot_insert", "A14 C5",
    s.cte("hourly", **_FRAMES) + f"SELECT station, time, pm25, pm10, {_LACKING} AS no2, {_LACKING} AS pm1 FROM old UNION ALL "
    f"SELECT station, time, {_LACKING}, {_LACKING}, no2, pm1 FROM wide w WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.station = w.station AND o.time = w.time) UNION ALL "
    f"SELECT station, time, {_LACKING}, pm10, {_LACKING}, {_LACKING} FROM narrow n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.station = n.station AND o.time = n.time) "
    "AND NOT EXISTS (SELECT 1 FROM wide o WHERE o.station = n.station AND o.time = n.time)", "pm25 pm10 no2 pm1",
)
def _(spark, d):
    """New rows only, into a table by day; every frame twice."""
    out = place(spark, "table")
    old, *more = frames(spark, d)
    writers.write_by_day(old, out)
    for frame in (old, *more, *more):
        writers.insert_new(frame, out, KEY)
    return known(writers.stored(spark, out))


@query(
    "snapshot_upsert", "A10 A12",
    s.cte("hourly", **_FRAMES) + "SELECT coalesce(o.station, w.station, n.station) AS station, coalesce(o.time, w.time, n.time) AS time, o.pm25, coalesce(n.pm10, o.pm10) AS pm10, w.no2, w.pm1 "
    "FROM old o FULL JOIN wide w ON o.station = w.station AND o.time = w.time FULL JOIN narrow n ON n.station = coalesce(o.station, w.station) AND n.time = coalesce(o.time, w.time)",
    "pm25 pm10 no2 pm1",
)
def _(spark, d):
    """Values merged column by column; what a frame does not know stays."""
    out = place(spark, "table")
    for frame in frames(spark, d):
        writers.upsert_by_day(frame, out, KEY)
    return known(writers.stored(spark, out))


@query(
    "snapshot_keep_last", "A13 A15",
    s.cte("hourly", **_FRAMES, u=f"SELECT 0 AS k, station, time, pm25, pm10, {_LACKING} AS no2, {_LACKING} AS pm1 FROM old UNION ALL SELECT 1, station, time, {_LACKING}, {_LACKING}, no2, pm1 FROM wide "
          f"UNION ALL SELECT 2, station, time, {_LACKING}, pm10, {_LACKING}, {_LACKING} FROM narrow",
          r="SELECT *, row_number() OVER (PARTITION BY station, time ORDER BY k DESC) AS rn FROM u") + f"SELECT {_KNOWN} FROM r WHERE rn = 1", "pm25 pm10 no2 pm1",
)
def _(spark, d):
    """Whole rows replaced, then the folders of each day joined and the old snapshots dropped."""
    out = place(spark, "table")
    for frame in frames(spark, d):
        writers.upsert_keep_last(frame, out, KEY)
    snapshots.compact(spark, out)
    snapshots.vacuum(spark, out, keep=1)
    return known(writers.stored(spark, out))


@query(
    "snapshot_history", "A10 A15 A16",
    s.cte("hourly", **_FRAMES, n="SELECT (SELECT count(*) FROM old) AS a, (SELECT count(*) FROM wide) AS b, (SELECT count(*) FROM narrow) AS c")
    + "SELECT CAST(0 AS BIGINT) AS version, CAST(4 AS INTEGER) AS n_columns, a AS n_rows FROM n UNION ALL SELECT 1, 6, a + b FROM n UNION ALL SELECT 2, 6, a + b + c FROM n UNION ALL SELECT 3, 4, b FROM n",
)
def _(spark, d):
    """Every snapshot of a table stays readable: three appends and a full refresh."""
    out = place(spark, "table")
    old, wide, narrow = frames(spark, d)
    for frame in (old, wide, narrow):
        writers.write_by_day(frame, out)
    writers.write_by_day(wide, out, "overwrite")
    counts = [writers.stored(spark, out, v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n_rows")) for v in snapshots.versions(spark, out)]
    joined = snapshots.history(spark, out).select("version", "n_columns").join(reshape.union_by_name(*counts), "version")
    return joined.select("version", "n_columns", "n_rows")


@query(
    "stored_widening", "A9 A11",
    s.cte("hourly") + "SELECT station, time, pm25, CAST(NULL AS DOUBLE) AS co, CAST(-1 AS BIGINT) AS n_aqi FROM hourly UNION ALL "
    "SELECT station, time, NULL, co, CAST(round_even(coalesce(co, 0), 0) AS BIGINT) FROM hourly", "pm25 co",
)
def _(spark, d):
    h = feeds.hourly_wide(spark, d)
    out = place(spark, "table")
    writers.append_widening(h.select("station", "time", "pm25"), out)
    table = writers.append_widening(h.select("time", "station", "co", F.coalesce("co", F.lit(0.0)).alias("n_aqi")), out)
    return table.select("station", "time", "pm25", "co", F.coalesce("n_aqi", F.lit(-1).cast("long")).alias("n_aqi"))


@query(
    "partitioned_scan", "A10 A16 B2",
    s.cte("readings") + "SELECT count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM readings WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
)
def _(spark, d):
    out = place(spark, "table")
    writers.write_by_day(feeds.readings(spark, d), out)
    days = F.col("date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return writers.verify_load(writers.stored(spark, out).where(days))


@query(
    "stored_forecast", "A18 K10",
    s.cte("target", lasts="SELECT station, max(time) AS last FROM target GROUP BY 1",
          a="SELECT station, last + (range * INTERVAL 1 HOUR) AS time, CAST(range AS INTEGER) AS horizon FROM lasts, range(1, 25)")
    + "SELECT a.station, a.time, a.horizon, overall_aqi AS forecast, TIMESTAMP '2024-02-01 00:00:00' AS forecast_timestamp FROM a LEFT JOIN target t ON a.station = t.station AND t.time = a.time - INTERVAL 24 HOUR",
    "forecast",
)
def _(spark, d):
    out = place(spark, "table")
    writers.save_forecast(forecasting.seasonal_naive(target(spark, d)), out, "2024-02-01 00:00:00")
    return spark.read.parquet(out)


@query(
    "saved_dataset", "A8 A15",
    s.cte("hourly") + "SELECT CAST(count(*) AS BIGINT) AS num_records, (SELECT string_agg(station, ', ' ORDER BY station) FROM (SELECT DISTINCT station FROM hourly)) AS stations, "
    "'2024-02-01' AS generated_on, 'hourly mean' AS first_step FROM hourly",
)
def _(spark, d):
    data, side = place(spark, "data"), place(spark, "meta")
    writers.save_with_metadata(feeds.hourly_wide(spark, d), data, side, ["hourly mean", "score"], "2024-02-01")
    kinds = "generated_on STRING, num_records BIGINT, time_range STRING, stations STRING, processing_steps ARRAY<STRING>"
    return spark.read.schema(kinds).json(side).select("num_records", "stations", "generated_on", F.col("processing_steps")[0].alias("first_step"))


@query(
    "created_table", "A9",
    s.cte("readings") + "SELECT parameter, count(*) AS n FROM readings GROUP BY 1",
)
def _(spark, d):
    """The table is external, at the shared folder, so no warehouse folder is needed."""
    name = f"readings_{uuid.uuid4().hex[:12]}"
    writers.create_table(feeds.readings(spark, d), name, path=place(spark, name))
    return spark.table(name).groupBy("parameter").agg(F.count("*").alias("n"))


@query(
    "hour_floor_counts", "I21 D1",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
)
def _(spark, d):
    return feeds.events(spark, d).groupBy(floor_to(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))
