"""Joins, de-duplication, upserts and the source merge."""

from pyspark.sql import functions as F

from airgrid.functions.clock import floor_to
from airgrid.operators import dedup, filters, joins, reshape
from airgrid.plans import feeds
from airgrid.plans.merge import average_then_score, city_weather, merge_sources, raw_source_hourly, weather_source_hourly
from airgrid.queries import sqlbase as s
from airgrid.queries.registry import query
from airgrid.session import cut_lineage
from airgrid.schema import KEY, POLLUTANTS, WEATHER_NUMERIC

ALL = " ".join(POLLUTANTS)
NUM = [*POLLUTANTS, *WEATHER_NUMERIC]


def lookup(spark):
    """Feed names of four of the five stations; the fifth is unknown on purpose."""
    return spark.createDataFrame([(f"Site {i}", f"S{i}") for i in range(4)], "alias STRING, name STRING")


def raw_utc(spark, d):
    """Second source: raw concentrations, UTC times, feed names."""
    wide = feeds.raw_wide(spark, d)
    return wide.select(
        F.col("time").alias("utc_time"), F.concat(F.lit("Site "), F.substring("station", 2, 9)).alias("location_name"), *POLLUTANTS
    )


def scored_table(spark, d):
    """First source: hourly index values, as a stored table (it is read for its rows and its time range)."""
    return cut_lineage(average_then_score(feeds.hourly_wide(spark, d)))


def hub_weather(spark, d):
    """Third source: weather rows with the pollutants the hub publishes itself."""
    w = feeds.weather(spark, d)
    return w.select("event_id", "time", "station", *[
        (F.col("humidity") if p == "pm25" else F.lit(None).cast("double")).alias(p) for p in POLLUTANTS
    ], *WEATHER_NUMERIC, "weather_icon")


_CARRY = "PARTITION BY station ORDER BY time, event_id ROWS BETWEEN"
_FILLED = "SELECT event_id, time, station, humidity AS hum, weather_icon, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER ({_CARRY} UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER ({_CARRY} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in WEATHER_NUMERIC
) + " FROM weather WHERE station = 'S0'"
_MERGE_PARTS = {
    "filled": _FILLED,
    "hub_icon": "SELECT time, weather_icon FROM (SELECT date_trunc('hour', time) AS time, weather_icon, row_number() OVER (PARTITION BY date_trunc('hour', time) ORDER BY count(*) DESC, weather_icon) AS rn FROM filled GROUP BY 1, 2) WHERE rn = 1",
    "hub_mean": "SELECT date_trunc('hour', time) AS time, avg(hum) AS pm25, " + ", ".join(f"avg({c}) AS {c}" for c in WEATHER_NUMERIC) + " FROM filled GROUP BY 1",
    "hub": f"SELECT m.time, 'S0' AS station, pm25, {s.WN}, weather_icon FROM hub_mean m JOIN hub_icon i ON m.time = i.time",
    "hours": "SELECT unnest(generate_series(least((SELECT min(time) FROM scored), (SELECT min(time) FROM hub)), greatest((SELECT max(time) FROM scored), (SELECT max(time) FROM hub)), INTERVAL 1 HOUR)) AS time",
    "wraw": f"SELECT h.time, {s.WN}, weather_icon FROM hours h LEFT JOIN hub ON h.time = hub.time",
    "wint": s.interpolated("wraw", WEATHER_NUMERIC, key=""),
    "city": f"SELECT time, {s.WN}, coalesce(last_value(weather_icon IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(weather_icon IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS weather_icon FROM wint",
    "applied": f"SELECT s.time, s.station, {s.P}, {s.WN}, weather_icon FROM scored s LEFT JOIN city c ON s.time = c.time",
}


@query(
    "weather_broadcast_join", "C1 S19",
    s.cte("scored", "weather", **_MERGE_PARTS) + f"SELECT time, station, {s.P}, {s.WN}, weather_icon FROM applied", " ".join(NUM),
)
def _(spark, d):
    scored = scored_table(spark, d)
    hub = cut_lineage(weather_source_hourly(hub_weather(spark, d).where(F.col("station") == feeds.HUB), ["event_id"]))
    return joins.with_city_weather(scored, city_weather(hub, scored)).select("time", "station", *NUM, "weather_icon")


_RAW2 = {
    "utc": "SELECT date_trunc('hour', time + INTERVAL 7 HOUR) AS time, CASE WHEN station = 'S4' THEN 'Site 4' ELSE station END AS station, "
    + ", ".join(f"avg({s.score(p, 'rounded', p)}) AS {p}" for p in POLLUTANTS) + " FROM raw_wide GROUP BY 1, 2",
}
_UNIQUE = {
    "tagged": f"SELECT time, station, {s.P}, {s.WN}, weather_icon, 0 AS src FROM applied UNION ALL "
    f"SELECT time, station, pm25, NULL, NULL, NULL, NULL, NULL, {s.WN}, weather_icon, 1 FROM hub",
    "counted": "SELECT *, " + " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in [*NUM, "weather_icon"]) + " AS known FROM tagged",
    "uniq": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, station ORDER BY known DESC, src) AS rn FROM counted) WHERE rn = 1",
}


def _reconciled(old: str, new: str, keep: str) -> str:
    nulls = lambda t: " + ".join(f"({t}.{p} IS NULL)::INTEGER" for p in POLLUTANTS)
    cells = ", ".join(
        f"CASE WHEN n.time IS NOT NULL AND {nulls('n')} <= {nulls('o')} THEN coalesce(n.{p}, o.{p}) ELSE coalesce(o.{p}, n.{p}) END AS {p}" for p in POLLUTANTS
    )
    return f"SELECT o.time, o.station, {cells}{keep} FROM {old} o LEFT JOIN {new} n ON o.time = n.time AND o.station = n.station"


@query(
    "merge_sources", "C1 C8 F5 D4 D6 G1 G6 H6 E8 B4 I19 S13 S14 S19",
    s.cte("scored", "weather", "raw_wide", **_MERGE_PARTS, **_RAW2, **_UNIQUE) + _reconciled("uniq", "utc", f", {s.WN}, weather_icon"),
    " ".join(NUM),
)
def _(spark, d):
    merged = merge_sources(
        scored_table(spark, d), raw_utc(spark, d), hub_weather(spark, d), lookup(spark), feeds.HUB, ["event_id"]
    )
    return merged.select("time", "station", *POLLUTANTS, *WEATHER_NUMERIC, "weather_icon")


_STORED = "SELECT time, station, pm25 FROM hourly WHERE time < TIMESTAMP '2024-01-25 06:00:00'"


@query(
    "incremental_filter", "B4 S18",
    s.cte("hourly", "raw_wide", "weather", stored=_STORED, b="SELECT max(time) - INTERVAL 1 HOUR AS lo FROM stored")
    + "SELECT 'readings' AS source, count(*) AS n, min(time) AS first_time FROM hourly, b WHERE time > lo UNION ALL "
    "SELECT 'weather', count(*), min(time) FROM weather, b WHERE time > lo - INTERVAL 24 HOUR UNION ALL "
    "SELECT 'utc', count(*), min(time) FROM raw_wide, b WHERE time > lo - INTERVAL 7 HOUR - INTERVAL 1 HOUR",
)
def _(spark, d):
    hourly = feeds.hourly_wide(spark, d)
    bounds = filters.incremental_bounds(hourly.where(F.col("time") < F.lit("2024-01-25 06:00:00").cast("timestamp_ntz")))
    parts = [
        filters.newer_than(frame, bounds[name]).agg(F.count("*").alias("n"), F.min("time").alias("first_time")).select(F.lit(name).alias("source"), "*")
        for name, frame in (("readings", hourly), ("weather", feeds.weather(spark, d)), ("utc", feeds.raw_wide(spark, d)))
    ]
    return reshape.union_by_name(*parts)


@query(
    "merge_incremental", "B4 C8 S18",
    s.cte(
        "hourly", "readings", "raw_wide", stored=_STORED, bound="SELECT max(time) - INTERVAL 1 HOUR AS lo FROM stored",
        scored="SELECT time, station, " + ", ".join(f"{s.score(p, 'rounded', p)} AS {p}" for p in POLLUTANTS) + " FROM hourly, bound WHERE time > lo",
        weather=s.PARTS["weather"][1].replace(" FROM events", " FROM events, bound WHERE ts > lo - INTERVAL 24 HOUR"),
        **_MERGE_PARTS,
        utc=_RAW2["utc"].replace(" FROM raw_wide", " FROM raw_wide, bound WHERE time > lo - INTERVAL 8 HOUR"),
        tagged=_UNIQUE["tagged"].replace(" FROM hub", " FROM hub, bound WHERE time > lo"), counted=_UNIQUE["counted"], uniq=_UNIQUE["uniq"],
    ) + _reconciled("uniq", "utc", f", {s.WN}, weather_icon"),
    " ".join(NUM),
)
def _(spark, d):
    hourly = scored_table(spark, d)
    stored = hourly.where(F.col("time") < F.lit("2024-01-25 06:00:00").cast("timestamp_ntz"))
    merged = merge_sources(
        hourly, raw_utc(spark, d), hub_weather(spark, d), lookup(spark), feeds.HUB, ["event_id"], merged=stored
    )
    return merged.select("time", "station", *POLLUTANTS, *WEATHER_NUMERIC, "weather_icon")


_HALVES = {
    "old": "SELECT station, time, pm25, pm10, CAST(NULL AS DOUBLE) AS no2 FROM hourly",
    "new": "SELECT station, time + INTERVAL 1 HOUR AS time, CAST(NULL AS DOUBLE) AS pm25, pm10, no2 FROM hourly",
}


def halves(spark, d):
    """An old and a new version of the hourly table, each knowing other columns, one hour apart."""
    h = feeds.hourly_wide(spark, d)
    none = F.lit(None).cast("double")
    old = h.select("station", "time", "pm25", "pm10", none.alias("no2"))
    new = h.select("station", (F.col("time") + F.expr("INTERVAL 1 HOUR")).alias("time"), none.alias("pm25"), "pm10", "no2")
    return old, new


@query(
    "upsert_coalesce", "A12 S17 N6",
    s.cte("hourly", **_HALVES) + "SELECT coalesce(o.station, n.station) AS station, coalesce(o.time, n.time) AS time, coalesce(n.pm25, o.pm25) AS pm25, "
    "coalesce(n.pm10, o.pm10) AS pm10, coalesce(n.no2, o.no2) AS no2 FROM old o FULL JOIN new n ON o.station = n.station AND o.time = n.time",
    "pm25 pm10 no2",
)
def _(spark, d):
    old, new = halves(spark, d)
    return joins.merge_coalesce(old, new, KEY)


@query(
    "reconcile_sources", "C8 S13",
    s.cte("hourly", "raw_wide", **_RAW2) + _reconciled("hourly", "utc", ""), ALL,
)
def _(spark, d):
    old = feeds.hourly_wide(spark, d).select("time", "station", *POLLUTANTS)
    return joins.reconcile(old, raw_source_hourly(raw_utc(spark, d), lookup(spark)), KEY, POLLUTANTS)


@query(
    "keep_last", "A13 F6 G1",
    s.cte("hourly", **_HALVES, u="SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new",
          r="SELECT *, row_number() OVER (PARTITION BY station, time ORDER BY src DESC) AS rn FROM u")
    + "SELECT station, time, pm25, pm10, no2 FROM r WHERE rn = 1", "pm25 pm10 no2",
)
def _(spark, d):
    old, new = halves(spark, d)
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    return dedup.keep_last(both, KEY, ["src"]).drop("src")


@query(
    "keep_first", "F4 F7",
    s.cte("readings", r="SELECT *, row_number() OVER (PARTITION BY station, parameter, date_trunc('hour', time) ORDER BY time, event_id) AS rn FROM readings")
    + "SELECT event_id, station, time, parameter, value FROM r WHERE rn = 1",
)
def _(spark, d):
    r = feeds.readings(spark, d).withColumn("hour", floor_to(F.col("time")))
    return dedup.keep_first(r, ["station", "parameter", "hour"], ["time", "event_id"]).drop("hour")


@query(
    "keep_most_complete", "F5 I9 S14",
    s.cte("hourly", **_HALVES, u="SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new",
          c="SELECT *, (pm25 IS NOT NULL)::INTEGER + (pm10 IS NOT NULL)::INTEGER + (no2 IS NOT NULL)::INTEGER AS known FROM u",
          r="SELECT *, row_number() OVER (PARTITION BY station, time ORDER BY known DESC, src) AS rn FROM c")
    + "SELECT station, time, pm25, pm10, no2, src FROM r WHERE rn = 1", "pm25 pm10 no2",
)
def _(spark, d):
    old, new = halves(spark, d)
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    return dedup.keep_most_complete(both, KEY, "src")


@query(
    "duplicate_flag", "E20",
    s.cte("hourly", **_HALVES, u="SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new")
    + "SELECT station, time, src, count(*) OVER (PARTITION BY station, time) > 1 AS is_duplicate FROM u",
)
def _(spark, d):
    old, new = halves(spark, d)
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    return dedup.flag_duplicates(both, KEY).select("station", "time", "src", "is_duplicate")


@query(
    "anti_join_new", "C5 A14 S16",
    s.cte("hourly", **_HALVES) + "SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.station = n.station AND o.time = n.time)", "pm25 pm10 no2",
)
def _(spark, d):
    old, new = halves(spark, d)
    return joins.only_new(new, old, KEY)


@query(
    "orders_without_lines", "C5",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_totalprice")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("key"))
    return joins.only_new(orders, lines, ["key"]).withColumnRenamed("key", "o_orderkey")


@query(
    "already_stored", "C6",
    s.cte("hourly", **_HALVES) + "SELECT n.station, count(*) AS n FROM new n WHERE EXISTS (SELECT 1 FROM old o WHERE o.station = n.station AND o.time = n.time) GROUP BY 1",
)
def _(spark, d):
    old, new = halves(spark, d)
    return joins.already_stored(new, old, KEY).groupBy("station").agg(F.count("*").alias("n"))


@query(
    "outer_on_time", "C3",
    s.cte("hourly", a="SELECT time, pm25 FROM hourly WHERE station = 'S1'", b="SELECT time, pm10 FROM hourly WHERE station = 'S2'")
    + "SELECT coalesce(a.time, b.time) AS time, pm25, pm10 FROM a FULL JOIN b ON a.time = b.time", "pm25 pm10",
)
def _(spark, d):
    h = feeds.hourly_wide(spark, d)
    return joins.outer_on_time(h.where("station = 'S1'").select("time", "pm25"), h.where("station = 'S2'").select("time", "pm10"))


@query(
    "join_listed_places", "C4",
    s.cte("hourly", "wx", b="SELECT time, wind_speed FROM wx WHERE station = 'S0'")
    + "SELECT h.time, h.station, pm25, wind_speed FROM hourly h JOIN b ON h.time = b.time WHERE h.station IN ('S1', 'S2', 'S3')", "pm25 wind_speed",
)
def _(spark, d):
    left = feeds.hourly_wide(spark, d).select("time", "station", "pm25")
    hub = feeds.hourly_weather_station(spark, d).where("station = 'S0'")
    right = hub.select("time", "wind_speed", F.lit("S1, S2 ,S3").alias("places"))
    return joins.join_listed_places(left, right, "time", "station", "places")


@query(
    "join_places_fallback", "C4 C3",
    s.cte("hourly", "wx", a="SELECT time, station, pm25 FROM hourly WHERE station = 'S1'", b="SELECT time, wind_speed FROM wx WHERE station = 'S0'")
    + "SELECT coalesce(a.time, b.time) AS time, station, pm25, wind_speed FROM a FULL JOIN b ON a.time = b.time", "pm25 wind_speed",
)
def _(spark, d):
    left = feeds.hourly_wide(spark, d).where("station = 'S1'").select("time", "station", "pm25")
    hub = feeds.hourly_weather_station(spark, d).where("station = 'S0'")
    right = hub.select("time", "wind_speed", F.lit("nowhere, elsewhere").alias("places"))
    return joins.join_listed_places(left, right, "time", "station", "places")


@query(
    "map_names", "B7 S12",
    s.cte("readings", l="SELECT 'Site ' || substr(station, 2) AS feed, station FROM readings")
    + "SELECT CASE WHEN feed = 'Site 4' THEN feed ELSE station END AS place, count(*) AS n, feed = 'Site 4' AS unmapped FROM l GROUP BY 1, 3",
)
def _(spark, d):
    raw = raw_utc(spark, d).select(F.col("location_name").alias("place"))
    unknown = joins.unmapped_names(raw, lookup(spark), "place").select("place", F.lit(True).alias("unmapped"))
    mapped = joins.map_names(raw, lookup(spark), "place").groupBy("place").agg(F.count("*").alias("n"))
    return mapped.join(unknown, "place", "left").withColumn("unmapped", F.coalesce("unmapped", F.lit(False)))


@query(
    "station_weather_join", "C2 K9",
    s.cte("hourly", "wx", g="SELECT station, max(time) - INTERVAL 30 HOUR AS base FROM hourly GROUP BY 1",
          f="SELECT station, base + (range * INTERVAL 1 HOUR) AS time FROM g, range(1, 25)")
    + "SELECT f.station, f.time, temperature, weather_icon FROM f LEFT JOIN wx w ON f.station = w.station AND f.time = w.time", "temperature",
)
def _(spark, d):
    from airgrid.operators.grid import future_hours

    base = feeds.hourly_wide(spark, d).withColumn("time", F.col("time") - F.expr("INTERVAL 30 HOURS"))
    wx = feeds.hourly_weather_station(spark, d).select("station", "time", "temperature", "weather_icon")
    return joins.with_station_weather(future_hours(base, 24).drop("horizon"), wx)


@query(
    "widening_append", "A11 G1",
    s.cte("hourly") + "SELECT station, time, CAST(round_even(pm25, 0) AS BIGINT) AS pm25_aqi, pm10 FROM hourly", "pm10",
)
def _(spark, d):
    stored = spark.createDataFrame([], "station STRING, time TIMESTAMP_NTZ, pm25_aqi BIGINT").schema
    incoming = feeds.hourly_wide(spark, d).select("time", "station", F.col("pm25").alias("pm25_aqi"), "pm10")
    return reshape.widen(stored, incoming)
