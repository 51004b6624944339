"""Buckets, profiles and station reports."""

from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to
from airgrid.functions.scales import category
from airgrid.operators import buckets, dedup, filters, profile
from airgrid.operators.quantiles import exact_mode, quantile_row
from airgrid.plans import feeds, reports
from airgrid.plans.features import with_overall
from airgrid.plans.merge import average_then_score
from airgrid.queries import sqlbase as s
from airgrid.queries.registry import query
from airgrid.schema import POLLUTANTS, WEATHER_NUMERIC
from airgrid.sources import readers, writers

MEASURED = feeds.MEASURED
ALL = " ".join(POLLUTANTS)


def scored_hourly(spark, d):
    return with_overall(average_then_score(feeds.hourly_wide(spark, d)))


@query("hourly_station_mean", "D1 D2 G2 B20 I21", s.cte("hourly") + f"SELECT station, time, {s.P} FROM hourly", ALL)
def _(spark, d):
    return feeds.hourly_wide(spark, d).select("station", "time", *POLLUTANTS)


@query(
    "time_bucket_exprs", "D1 O3 B2",
    s.cte("readings") + "SELECT time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '1970-01-01') AS bucket, parameter, avg(value) AS mean, max(value) AS top, count(*) AS n "
    "FROM readings WHERE value > 1 GROUP BY 1, 2",
    "mean",
)
def _(spark, d):
    r = feeds.readings(spark, d)
    out = buckets.time_bucket(r, "6 hours", ["avg(value) AS mean", F.max("value").alias("top"), "count(*) AS n"], ["parameter"], where="value > 1")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "daily_min_max", "D3",
    s.cte("readings") + "SELECT station, date_trunc('day', time) AS day, avg(value) AS mean, max(value) AS top, min(value) AS low "
    "FROM readings WHERE parameter = 'pm25' GROUP BY 1, 2", "mean",
)
def _(spark, d):
    r = feeds.readings(spark, d).where(F.col("parameter") == "pm25")
    return buckets.time_bucket(
        r, "1 day", [F.avg("value").alias("mean"), F.max("value").alias("top"), F.min("value").alias("low")], ["station"], name="day"
    )


@query("hour_mode_icon", "D4 O2", s.cte("wx") + f"SELECT station, time, {s.WN}, weather_icon FROM wx", " ".join(WEATHER_NUMERIC))
def _(spark, d):
    return feeds.hourly_weather_station(spark, d).select("station", "time", *WEATHER_NUMERIC, "weather_icon")


@query(
    "city_weather_hourly", "D5",
    s.cte("weather", m="SELECT date_trunc('hour', time) AS time, avg(temperature) AS temperature, avg(humidity) AS humidity, avg(wind_speed) AS wind_speed FROM weather GROUP BY 1",
          i="SELECT time, weather_icon FROM (SELECT date_trunc('hour', time) AS time, weather_icon, row_number() OVER (PARTITION BY date_trunc('hour', time) ORDER BY count(*) DESC, weather_icon) AS rn FROM weather GROUP BY 1, 2) WHERE rn = 1")
    + "SELECT m.time, temperature, humidity, wind_speed, weather_icon, 'City' AS place FROM m JOIN i USING (time)",
    "temperature humidity wind_speed",
)
def _(spark, d):
    w = feeds.weather(spark, d)
    hourly = buckets.hourly_weather(w, ["temperature", "humidity", "wind_speed"], "weather_icon", keys=())
    return hourly.withColumn("place", F.lit("City"))


@query(
    "city_index_hourly", "D7",
    s.cte("overall", b=f"SELECT time, overall_aqi, {s.category('overall_aqi')} AS band FROM overall",
          m="SELECT time, avg(overall_aqi) AS overall_aqi FROM b GROUP BY 1",
          c="SELECT time, band FROM (SELECT time, band, row_number() OVER (PARTITION BY time ORDER BY count(*) DESC, band) AS rn FROM b GROUP BY 1, 2) WHERE rn = 1")
    + "SELECT time, overall_aqi, band FROM m JOIN c USING (time)", "overall_aqi",
)
def _(spark, d):
    return reports.city_hourly(scored_hourly(spark, d).withColumn("band", category(F.col("overall_aqi"))), ["overall_aqi"], "band")


@query(
    "hour_of_day", "D8",
    s.cte("readings") + "SELECT station, CAST(hour(time) AS INTEGER) AS hour, avg(value) AS mean_value FROM readings GROUP BY 1, 2", "mean_value",
)
def _(spark, d):
    return buckets.by_hour_of_day(feeds.readings(spark, d), "value", ["station"])


@query(
    "day_of_week", "D9 I22",
    s.cte("readings") + "SELECT station, CAST(isodow(time) - 1 AS INTEGER) AS day_of_week, avg(value) AS mean_value FROM readings GROUP BY 1, 2", "mean_value",
)
def _(spark, d):
    return buckets.by_weekday(feeds.readings(spark, d), "value", ["station"])


@query(
    "station_summary", "D10",
    s.cte("readings") + "SELECT station, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, count(DISTINCT date_trunc('day', time)) AS n_days FROM readings GROUP BY 1",
)
def _(spark, d):
    return profile.key_summary(feeds.readings(spark, d))


@query(
    "mean_by_station_type", "D11",
    s.cte("raw_wide") + "SELECT station, CASE WHEN value_kind THEN 'stat' ELSE 'aqi' END AS data_type, " + ", ".join(f"avg({p}) AS {p}" for p in MEASURED)
    + " FROM (SELECT *, hour(time) < 12 AS value_kind FROM raw_wide) GROUP BY 1, 2", " ".join(MEASURED),
)
def _(spark, d):
    kind = F.when(F.hour("time") < 12, "stat").otherwise("aqi")
    return feeds.raw_wide(spark, d).groupBy("station", kind.alias("data_type")).agg(*[F.avg(p).alias(p) for p in MEASURED])


@query("value_counts", "D12", s.cte("readings") + "SELECT parameter, station, count(*) AS n FROM readings GROUP BY 1, 2")
def _(spark, d):
    return profile.value_counts(feeds.readings(spark, d), "parameter", "station")


@query(
    "null_report", "D13",
    s.cte("hourly") + " UNION ALL ".join(f"SELECT '{p}' AS \"column\", count(*) - count({p}) AS n_null, (count(*) - count({p})) * 100e0 / count(*) AS pct_null FROM hourly" for p in POLLUTANTS),
    "pct_null",
)
def _(spark, d):
    return profile.null_report(feeds.hourly_wide(spark, d), POLLUTANTS)


@query(
    "describe", "D14 D16",
    s.cte("raw_wide") + " UNION ALL ".join(
        f"SELECT '{p}' AS \"column\", count({p}) AS n, avg({p}) AS mean, stddev_samp({p}) AS std, min({p}) AS min, quantile_cont({p}, 0.25) AS q25, "
        f"quantile_cont({p}, 0.5) AS q50, quantile_cont({p}, 0.75) AS q75, max({p}) AS max FROM raw_wide" for p in MEASURED
    ),
    "mean std q25 q50 q75",
)
def _(spark, d):
    return profile.describe(feeds.raw_wide(spark, d), MEASURED)


@query(
    "distinct_counts", "D15",
    s.cte("readings") + "SELECT 'station' AS \"column\", 'string' AS dtype, count(DISTINCT station) AS n_distinct FROM readings UNION ALL "
    "SELECT 'parameter', 'string', count(DISTINCT parameter) FROM readings UNION ALL SELECT 'value', 'double', count(DISTINCT value) FROM readings UNION ALL "
    "SELECT 'event_id', 'bigint', count(DISTINCT event_id) FROM readings",
)
def _(spark, d):
    return profile.distinct_counts(feeds.readings(spark, d), ["station", "parameter", "value", "event_id"]).select("column", "dtype", "n_distinct")


@query(
    "center_values", "D16",
    s.cte("weather") + "SELECT avg(wind_speed) AS mean, quantile_cont(wind_speed, 0.5) AS median, "
    "(SELECT weather_icon FROM weather GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_icon, "
    "(SELECT wind_speed FROM weather GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_value FROM weather",
    "mean median mode_value",
)
def _(spark, d):
    w = feeds.weather(spark, d)
    return w.agg(F.avg("wind_speed").alias("mean")).withColumns(
        {
            "median": quantile_row(w, ["wind_speed"], {"q": 0.5}).scalar(),
            "mode_icon": exact_mode(w, "weather_icon").scalar(),
            "mode_value": exact_mode(w, "wind_speed").scalar(),
        }
    )


def _corr_sql() -> str:
    parts = []
    for a in MEASURED:
        for b in MEASURED:
            value = "1e0" if a == b else f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {value} AS corr FROM hourly")
    same = [p.replace("1e0 AS corr FROM hourly", "1e0 AS corr") for p in parts]
    return s.cte("hourly") + " UNION ALL ".join(same)


@query("correlation_matrix", "D17", _corr_sql(), "corr")
def _(spark, d):
    return profile.correlation_matrix(feeds.hourly_wide(spark, d), MEASURED)


@query(
    "target_correlation", "D18",
    s.cte("model_gaps") + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, overall_aqi) AS corr FROM model_gaps" for c in WEATHER_NUMERIC if c != "dew")
    + ") ORDER BY corr DESC, feature LIMIT 4", "corr",
)
def _(spark, d):
    wide = scored_hourly(spark, d).select("station", "time", "overall_aqi")
    joined = wide.join(feeds.hourly_weather_station(spark, d), ["station", "time"], "left")
    return profile.target_correlation(joined, [c for c in WEATHER_NUMERIC if c != "dew"], "overall_aqi", 4)


@query(
    "histogram", "D19",
    s.cte("readings", m="SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30e0 AS w FROM readings",
          c="SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM readings, m GROUP BY 1",
          b="SELECT CAST(range AS INTEGER) AS bin FROM range(30)")
    + "SELECT b.bin, lo + b.bin * w AS low, lo + (b.bin + 1) * w AS high, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin, m",
    "low high",
)
def _(spark, d):
    return profile.histogram(feeds.readings(spark, d), "value", 30)


@query(
    "box_summary", "D20",
    s.cte("overall", t="SELECT station, CAST(isodow(time) - 1 AS INTEGER) AS day_of_week, overall_aqi AS x FROM overall",
          q="SELECT station, day_of_week, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM t GROUP BY 1, 2")
    + "SELECT t.station, t.day_of_week, q1, median, q3, min(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low, "
    "max(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high, "
    "count(CASE WHEN NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS n_outside "
    "FROM t JOIN q ON t.station = q.station AND t.day_of_week = q.day_of_week GROUP BY 1, 2, 3, 4, 5",
    "q1 median q3 whisker_low whisker_high",
)
def _(spark, d):
    scored = scored_hourly(spark, d).withColumn("day_of_week", F.weekday("time"))
    return profile.box_summary(scored, "overall_aqi", ["station", "day_of_week"])


@query(
    "linear_fit", "D21",
    s.cte("model_gaps") + "SELECT station, regr_slope(overall_aqi, humidity) AS slope, regr_intercept(overall_aqi, humidity) AS intercept, "
    "CAST(regr_count(overall_aqi, humidity) AS BIGINT) AS n FROM model_gaps GROUP BY 1", "slope intercept",
)
def _(spark, d):
    wide = scored_hourly(spark, d).select("station", "time", "overall_aqi")
    return profile.linear_fit(wide.join(feeds.hourly_weather_station(spark, d), ["station", "time"], "left"), "overall_aqi", "humidity", ["station"])


@query(
    "interval_audit", "D22",
    s.cte("hourly", g="SELECT date_diff('hour', lag(time) OVER (PARTITION BY station ORDER BY time), time) AS step_hours FROM hourly")
    + "SELECT step_hours, count(*) AS n FROM g WHERE step_hours IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return profile.interval_audit(feeds.hourly_wide(spark, d))


@query(
    "overview", "D23 A16 B19",
    s.cte("readings") + "SELECT CAST(count(*) AS BIGINT) AS n_rows, min(time) AS first_time, max(time) AS last_time, "
    "(SELECT string_agg(station, ', ' ORDER BY station) FROM (SELECT DISTINCT station FROM readings)) AS keys FROM readings",
)
def _(spark, d):
    return profile.overview(feeds.readings(spark, d))


@query("verify_load", "A16", s.cte("readings") + "SELECT count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM readings")
def _(spark, d):
    return writers.verify_load(feeds.readings(spark, d))


@query(
    "station_list", "B19",
    s.cte("readings") + "SELECT string_agg(p, ', ' ORDER BY p) AS parameters FROM (SELECT DISTINCT parameter AS p FROM readings)",
)
def _(spark, d):
    return filters.distinct_text(feeds.readings(spark, d), "parameter", "parameters")


@query(
    "null_share_station", "D25 B17",
    s.cte("gaps") + "SELECT station, " + ", ".join(f"avg(CASE WHEN {p} IS NULL THEN 1e0 ELSE 0e0 END) AS {p}" for p in POLLUTANTS) + " FROM gaps GROUP BY 1", ALL,
)
def _(spark, d):
    from airgrid.operators.grid import expose_gaps

    return filters.null_shares(expose_gaps(feeds.hourly_wide(spark, d)), POLLUTANTS, ["station"])


@query(
    "drop_sparse_columns", "B17",
    s.cte("hourly") + "SELECT station, time, pm25, pm10, no2, so2, co FROM hourly", "pm25 pm10 no2 so2 co",
)
def _(spark, d):
    return filters.drop_sparse_columns(feeds.hourly_wide(spark, d), POLLUTANTS, 0.9)


@query(
    "busiest_stations", "B18",
    s.cte("readings", top="SELECT station FROM readings GROUP BY 1 ORDER BY count(*) DESC, station LIMIT 3")
    + "SELECT station, parameter, count(*) AS n FROM readings WHERE station IN (SELECT station FROM top) GROUP BY 1, 2",
)
def _(spark, d):
    return filters.busiest(feeds.readings(spark, d), 3).groupBy("station", "parameter").agg(F.count("*").alias("n"))


@query(
    "range_scan", "A5 A6 B1 B2 B3 S28",
    s.cte("readings", m="SELECT max(time) AS hi FROM readings")
    + "SELECT event_id AS id, time AS measured_at, station AS place, value FROM readings, m WHERE time BETWEEN hi - INTERVAL 10 DAY AND hi AND station IN ('S1', 'S3')",
)
def _(spark, d):
    rows = filters.historical(feeds.readings(spark, d), 10, ["S1", "S3"])
    return readers.scan(rows, {"event_id": "id", "time": "measured_at", "station": "place", "value": "value"})


@query(
    "recent_series", "M5 B3",
    s.cte("hourly") + "SELECT station, time, pm25 FROM hourly WHERE time > (SELECT max(time) FROM hourly) - INTERVAL 7 DAY", "pm25",
)
def _(spark, d):
    return reports.recent_series(feeds.hourly_wide(spark, d), 7).select("station", "time", "pm25")


@query(
    "compare_stations", "M6",
    s.cte("raw_wide") + "SELECT station, " + ", ".join(f"avg({p}) AS {p}" for p in POLLUTANTS)
    + " FROM raw_wide WHERE time > (SELECT max(time) FROM raw_wide) - INTERVAL 20 DAY GROUP BY 1", ALL,
)
def _(spark, d):
    return reports.compare_stations(feeds.raw_wide(spark, d), 20)


@query("index_series", "M2 F1", s.cte("overall") + "SELECT station, time, overall_aqi FROM overall")
def _(spark, d):
    return reports.index_series(average_then_score(feeds.hourly_wide(spark, d)))


@query("station_detail", "M3 B2", s.cte("hourly") + f"SELECT station, time, {s.P} FROM hourly WHERE station = 'S2'", ALL)
def _(spark, d):
    return reports.station_detail(feeds.hourly_wide(spark, d), "S2")


@query("pollutant_series", "M4 B16", s.cte("hourly") + "SELECT time, co AS value FROM hourly WHERE station = 'S4' AND co IS NOT NULL", "value")
def _(spark, d):
    return reports.pollutant_series(feeds.hourly_wide(spark, d), "S4", "co")


@query("band_summary", "M7", s.cte("overall") + f"SELECT {s.category('overall_aqi')} AS category, count(*) AS n FROM overall GROUP BY 1")
def _(spark, d):
    return reports.band_summary(scored_hourly(spark, d))


@query(
    "pollutant_vector", "M8",
    s.cte("hourly", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS rn FROM hourly")
    + " UNION ALL ".join(f"SELECT station, '{p}' AS pollutant, coalesce({p}, 0e0) AS value, coalesce({p}, 0e0) / 100e0 AS share FROM r WHERE rn = 1" for p in POLLUTANTS),
    "value share",
)
def _(spark, d):
    return reports.pollutant_vector(feeds.hourly_wide(spark, d))


@query(
    "latest_per_station", "E11 N8",
    s.cte("readings", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC, event_id DESC) AS rn FROM readings")
    + "SELECT event_id, station, time, parameter, value FROM r WHERE rn = 1",
)
def _(spark, d):
    return dedup.latest_per_key(feeds.readings(spark, d), tie=["event_id"])


@query("latest_n", "F2 F1", s.cte("readings") + "SELECT * FROM readings ORDER BY time DESC, event_id DESC LIMIT 25")
def _(spark, d):
    return feeds.readings(spark, d).orderBy(F.desc("time"), F.desc("event_id")).limit(25)


@query("top_values", "F3", s.cte("readings") + "SELECT event_id, station, parameter, value FROM readings ORDER BY value DESC, event_id LIMIT 10")
def _(spark, d):
    return feeds.readings(spark, d).orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "station", "parameter", "value")


@query(
    "null_mask_sample", "G9",
    s.cte("gaps", p="SELECT *, row_number() OVER (ORDER BY time, station) - 1 AS position, count(*) OVER () AS total FROM gaps")
    + "SELECT position, time, station, " + ", ".join(f"CAST({p} IS NULL AS INTEGER) AS {p}_missing" for p in POLLUTANTS)
    + " FROM p WHERE position % greatest(1, total // 1000) = 0",
)
def _(spark, d):
    from airgrid.operators.grid import expose_gaps

    return profile.null_mask_sample(expose_gaps(feeds.hourly_wide(spark, d)), POLLUTANTS, "time", "station")


@query(
    "daily_orders", "D1 D3",
    "SELECT date_trunc('month', o_orderdate) AS bucket, o_orderpriority, count(*) AS n, max(o_totalprice) AS top, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2",
    "mean",
)
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return buckets.time_bucket(
        orders, "1 month", ["count(*) AS n", "max(o_totalprice) AS top", "avg(o_totalprice) AS mean"], ["o_orderpriority"], time="o_orderdate"
    )


@query(
    "dataset_metadata", "A8",
    s.cte("hourly") + "SELECT '2024-02-01' AS generated_on, CAST(count(*) AS BIGINT) AS num_records, "
    "strftime(min(time), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(time), '%Y-%m-%d %H:%M:%S') AS time_range, "
    "(SELECT string_agg(station, ', ' ORDER BY station) FROM (SELECT DISTINCT station FROM hourly)) AS stations FROM hourly",
)
def _(spark, d):
    return writers.metadata(feeds.hourly_wide(spark, d), ["hourly mean"], "2024-02-01").drop("processing_steps")
