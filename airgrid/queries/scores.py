"""Index scales, bands and unit texts."""

from pyspark.sql import functions as F

from airgrid.functions import clock, icons, rows, scales, textunits
from airgrid.functions.sqlfuncs import register
from airgrid.plans import feeds, reports
from airgrid.plans.merge import score_then_average, stat_else_published
from airgrid.queries import sqlbase as s
from airgrid.queries.registry import query
from airgrid.schema import POLLUTANTS

INDEX = [f"aqi_{p}" for p in POLLUTANTS]


def _scale_sql(scale: str) -> str:
    cells = ", ".join(f"{s.score(p, scale, p)} AS aqi_{p}" for p in POLLUTANTS)
    # Means are cut to six digits first, so that both engines round the same decimal.
    six = "SELECT station, time, " + ", ".join(f"round({p}, 6) AS {p}" for p in POLLUTANTS) + " FROM hourly"
    return s.cte("hourly", six=six, sc=f"SELECT station, time, {cells} FROM six") + (
        f"SELECT station, time, {', '.join(INDEX)}, greatest({', '.join(INDEX)}) AS overall_aqi, "
        f"{s.category('greatest(' + ', '.join(INDEX) + ')')} AS aqi_category FROM sc"
    )


def _scale_query(scale: str, covers: str) -> None:
    @query(f"aqi_{scale}", covers, _scale_sql(scale), " ".join([*INDEX, "overall_aqi"]))
    def run(spark, d):
        wide = feeds.hourly_wide(spark, d)
        wide = wide.withColumns({p: F.round(F.col(p), 6) for p in POLLUTANTS})
        scored = scales.add_index_columns(wide, {p: p for p in POLLUTANTS}, scale)
        return scored.select("station", "time", *INDEX, "overall_aqi", "aqi_category")


_scale_query("rounded", "I1 I2 I6 I8 O1")
_scale_query("unconverted", "I5 I6")
_scale_query("gapped", "I3 I6")
_scale_query("continuous", "I4 I6")


_O3 = ["rounded", "unconverted", "gapped", "continuous"]


@query(
    "aqi_o3", "I1 I2 I3 I4 I5",
    "WITH v AS (SELECT event_id, round(value, 6) AS o3 FROM events) SELECT event_id, " + ", ".join(f"{s.score('o3', k, 'o3')} AS {k}" for k in _O3) + " FROM v", " ".join(_O3),
)
def _(spark, d):
    """Every reading taken as ozone, which the feeds do not carry, on all four scales."""
    values = feeds.events(spark, d).select("event_id", F.round("value", 6).alias("o3"))
    return values.select("event_id", *[scales.score("o3", "o3", k).alias(k) for k in _O3])


@query(
    "aqi_four_pollutants", "I6",
    s.cte("scored") + "SELECT station, time, greatest(pm25, pm10, no2, co) AS overall_aqi FROM scored",
)
def _(spark, d):
    wide = scales.add_index_columns(feeds.hourly_wide(spark, d), {p: p for p in ("pm25", "pm10", "no2", "co")})
    return wide.select("station", "time", "overall_aqi")


@query(
    "aqi_category_counts", "I7 D12 M7",
    s.cte("overall") + f"SELECT {s.category('overall_aqi')} AS category, {s.colour('overall_aqi')} AS colour, count(*) AS n "
    "FROM overall GROUP BY 1, 2",
)
def _(spark, d):
    scored = scales.add_index_columns(feeds.hourly_wide(spark, d), {p: p for p in POLLUTANTS})
    index = F.col("overall_aqi")
    return scored.groupBy(scales.category(index).alias("category"), scales.colour(index).alias("colour")).agg(F.count("*").alias("n"))


@query(
    "score_then_average", "D6 I1",
    s.cte("raw_wide") + "SELECT date_trunc('hour', time) AS time, station, "
    + ", ".join(f"avg({s.score(p, 'rounded', p)}) AS {p}" for p in POLLUTANTS) + " FROM raw_wide GROUP BY 1, 2",
    " ".join(POLLUTANTS),
)
def _(spark, d):
    return score_then_average(feeds.raw_wide(spark, d))


_PUBLISHED = "SELECT event_id, station, date_trunc('hour', time) AS time, CASE WHEN parameter IN ('pm25', 'pm10', 'no2') THEN 'stat' ELSE 'aqi' END AS data_type, parameter, value FROM readings"


@query(
    "stat_else_published", "C9 G3",
    s.cte(
        "readings", kinds=_PUBLISHED,
        firsts="SELECT station, time, data_type, parameter, value FROM (SELECT *, row_number() OVER (PARTITION BY station, time, data_type, parameter ORDER BY event_id) AS rn FROM kinds) WHERE rn = 1",
        cells="SELECT station, time, " + ", ".join(
            f"coalesce(max(CASE WHEN data_type = 'stat' AND parameter = '{p}' THEN {s.score(p, 'rounded', 'value')} END), "
            f"max(CASE WHEN data_type = 'aqi' AND parameter = '{p}' THEN value END)) AS aqi_{p}" for p in POLLUTANTS
        ) + " FROM firsts GROUP BY 1, 2",
    )
    + f"SELECT *, greatest({', '.join(INDEX)}) AS overall_aqi, {s.category('greatest(' + ', '.join(INDEX) + ')')} AS aqi_category FROM cells",
    " ".join([*INDEX, "overall_aqi"]),
)
def _(spark, d):
    measured = F.when(F.col("parameter").isin("pm25", "pm10", "no2"), "stat").otherwise("aqi")
    r = feeds.readings(spark, d).withColumns({"time": clock.floor_to(F.col("time")), "data_type": measured})
    return stat_else_published(r, ["event_id"])


_TEXTS = (
    "SELECT event_id, "
    "printf('%.1f', round_even(value, 1)) || CASE event_type WHEN 'click' THEN ' mph' WHEN 'error' THEN ' knots' ELSE ' km/h' END AS wind_speed, "
    f"CAST(CASE WHEN event_type = 'signup' THEN {s.K}::INTEGER * 11 ELSE {s.K}::INTEGER END AS VARCHAR) || '%' AS humidity, "
    f"CASE event_type WHEN 'view' THEN CAST({s.K}::INTEGER AS VARCHAR) || 'F' WHEN 'purchase' THEN CAST({s.K}::INTEGER - 50 AS VARCHAR) || '°C' "
    f"WHEN 'error' THEN 'n/a' ELSE CAST({s.K}::INTEGER AS VARCHAR) END AS temperature, "
    "'/icons/' || CASE event_type WHEN 'click' THEN 'ic-w-06-rain-full.svg' WHEN 'view' THEN 'ic-w-01-clear-sky-full.svg' "
    "WHEN 'purchase' THEN 'Partly-Cloudy-Night' WHEN 'signup' THEN 'light-rain' ELSE 'mist' END AS icon_url FROM events"
)


@query(
    "unit_parse", "I10 I11 I12 I13 I14 I16 B5",
    "WITH t AS (" + _TEXTS + ") SELECT event_id, "
    "CASE WHEN wind_speed LIKE '%mph' THEN round_even(CAST(replace(wind_speed, ' mph', '') AS DOUBLE) * 1.60934e0, 1) "
    "WHEN wind_speed LIKE '%km/h' THEN CAST(replace(wind_speed, ' km/h', '') AS DOUBLE) END AS wind_kmh, "
    "CASE WHEN length(humidity) BETWEEN 2 AND 4 THEN CAST(replace(humidity, '%', '') AS DOUBLE) END AS humidity_pct, "
    "CASE WHEN temperature = 'n/a' THEN NULL WHEN temperature LIKE '%F' THEN round_even((CAST(replace(temperature, 'F', '') AS DOUBLE) - 32) * 5 / 9, 0) "
    "WHEN temperature LIKE '%C' THEN CAST(replace(temperature, '°C', '') AS DOUBLE) "
    "WHEN CAST(temperature AS DOUBLE) > 50 THEN round_even((CAST(temperature AS DOUBLE) - 32) * 5 / 9, 0) ELSE CAST(temperature AS DOUBLE) END AS temp_c, "
    "try_cast(replace(replace(temperature, '°C', ''), ' km/h', '') AS DOUBLE) AS stripped, "
    "try_cast(regexp_extract(wind_speed, '([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS number FROM t",
    "wind_kmh temp_c",
)
def _(spark, d):
    t = feeds.weather_texts(spark, d)
    return t.select(
        "event_id",
        textunits.wind_kmh(F.col("wind_speed")).alias("wind_kmh"),
        textunits.humidity_percent(F.col("humidity")).alias("humidity_pct"),
        textunits.celsius(F.col("temperature")).alias("temp_c"),
        textunits.strip_unit(F.col("temperature")).alias("stripped"),
        textunits.first_number(F.col("wind_speed")).alias("number"),
    )


@query(
    "icon_category", "B10 B11 B12 B13",
    "WITH t AS (" + _TEXTS + "), l AS (SELECT CASE icon_url WHEN '/icons/ic-w-06-rain-full.svg' THEN 'rain' "
    "WHEN '/icons/ic-w-01-clear-sky-full.svg' THEN 'clear-day' ELSE replace(icon_url, '/icons/', '') END AS label, "
    "replace(icon_url, '/icons/', '') AS file FROM t) SELECT label, "
    "CASE WHEN lower(label) = 'partly-cloudy-night' THEN 'partly_cloudy' WHEN lower(label) = 'clear-day' THEN 'clear_sky' "
    "WHEN lower(label) LIKE '%rain%' THEN 'rain' ELSE 'other' END AS by_text, "
    "CASE file WHEN 'mist' THEN 'mist' WHEN 'ic-w-06-rain-full.svg' THEN 'rain' WHEN 'ic-w-01-clear-sky-full.svg' THEN 'clear_sky' ELSE 'other' END AS by_file, "
    "substr(label, 1, 2) AS code, count(*) AS n FROM l GROUP BY ALL",
)
def _(spark, d):
    t = feeds.weather_texts(spark, d)
    label = icons.icon_label(F.col("icon_url"))
    file = F.element_at(F.split("icon_url", "/"), -1)
    return t.select(
        label.alias("label"), icons.category_by_text(label).alias("by_text"), icons.category_exact(file).alias("by_file"),
        icons.icon_code(label).alias("code"),
    ).groupBy("label", "by_text", "by_file", "code").agg(F.count("*").alias("n"))


@query(
    "unit_format", "I15 I17 I18 I19 I20 I21 I26 B6",
    "SELECT event_id, printf('%.1f km/h', round_even(value, 1)) AS wind_text, "
    f"CAST({s.K}::BIGINT AS VARCHAR) || '%' AS humidity_text, "
    f"round_even({s.K} + 250e0 - 273.15e0, 2) AS celsius, "
    "ts + INTERVAL 7 HOUR AS local_time, date_trunc('hour', ts + INTERVAL 7 HOUR) AS local_hour, "
    "date_trunc('second', ts + INTERVAL 500 MILLISECONDS) AS near_second, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS iso, "
    "to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC' + INTERVAL 7 HOUR AS from_epoch, "
    "CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events",
    "celsius",
)
def _(spark, d):
    e = feeds.events(spark, d)
    k = feeds.payload(F.col("props"))
    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    slashed = F.when(F.col("event_type") == "click", F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(text)
    local = clock.utc_to_local(F.col("ts"))
    return e.select(
        "event_id",
        textunits.with_kmh(F.col("value")).alias("wind_text"),
        textunits.with_percent(k).alias("humidity_text"),
        textunits.kelvin_to_celsius(k + 250).alias("celsius"),
        local.alias("local_time"),
        clock.floor_to(local).alias("local_hour"),
        clock.nearest_second(F.col("ts")).alias("near_second"),
        clock.iso_text(F.col("ts")).alias("iso"),
        clock.epoch_to_local(clock.epoch_seconds(F.col("ts"))).alias("from_epoch"),
        clock.drop_zone(clock.parse_time(slashed, ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"))).alias("parsed"),
    )


@query(
    "row_validation", "B14 B15 B16",
    "WITH t AS (" + _TEXTS + "), v AS (SELECT event_id, wind_speed NOT LIKE '%knots' AS ok_wind, length(humidity) BETWEEN 2 AND 4 AS ok_humidity, temperature <> 'n/a' AS ok_temp FROM t) "
    "SELECT CASE WHEN ok_wind AND ok_humidity AND ok_temp THEN 'valid' ELSE concat_ws(',', CASE WHEN NOT ok_wind THEN 'wind' END, "
    "CASE WHEN NOT ok_humidity THEN 'humidity' END, CASE WHEN NOT ok_temp THEN 'temp' END) END AS outcome, count(*) AS n FROM v GROUP BY 1",
)
def _(spark, d):
    from airgrid.operators.filters import rejected_rows, valid_rows

    t = feeds.weather_texts(spark, d).select(
        "event_id", textunits.wind_kmh(F.col("wind_speed")).alias("wind"),
        textunits.humidity_percent(F.col("humidity")).alias("humidity"), textunits.celsius(F.col("temperature")).alias("temp"),
    )
    checked = ["wind", "humidity", "temp"]
    good = valid_rows(t, checked).select(F.lit("valid").alias("outcome"))
    bad = rejected_rows(t, checked).select(F.col("failed").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "sql_functions", "O5 A17",
    s.cte("readings") + f"SELECT station, count(*) AS n, avg({s.score('pm25', 'rounded', 'value')}) AS mean_index, "
    f"count(*) FILTER (WHERE {s.category(s.score('pm25', 'rounded', 'value'))} = 'Good') AS n_good FROM readings "
    "WHERE parameter = 'pm25' GROUP BY station",
    "mean_index",
)
def _(spark, d):
    from airgrid.sources.readers import run_sql

    register(spark)
    return run_sql(
        spark,
        "SELECT station, count(*) AS n, avg(aqi_pm25(value)) AS mean_index, "
        "count_if(aqi_category(aqi_pm25(value)) = 'Good') AS n_good FROM sensor_readings WHERE parameter = :p GROUP BY station",
        {"sensor_readings": feeds.readings(spark, d)}, p="pm25",
    )


@query(
    "safe_values", "B15 B5 I9 I29",
    s.cte("raw_wide") + "SELECT event_id, CASE WHEN pm25 > 100 THEN NULL ELSE pm25 END AS finite_pm25, "
    "CAST((pm25 IS NOT NULL)::INTEGER + (pm10 IS NOT NULL)::INTEGER + (no2 IS NOT NULL)::INTEGER + (o3 IS NOT NULL)::INTEGER + (co IS NOT NULL)::INTEGER + (so2 IS NOT NULL)::INTEGER AS INTEGER) AS n_known, "
    "CASE WHEN pm25 IS NOT NULL THEN greatest(least(pm25, 500), 0) / 500e0 END AS gauge FROM raw_wide",
    "finite_pm25 gauge",
)
def _(spark, d):
    wide = feeds.raw_wide(spark, d)
    inf = F.when(F.col("pm25") > 100, F.lit(float("inf"))).otherwise(F.col("pm25"))
    return wide.select(
        "event_id", rows.finite(inf).alias("finite_pm25"), rows.non_null_count(POLLUTANTS).alias("n_known"),
        rows.gauge(F.col("pm25"), 0, 500).alias("gauge"),
    )


@query(
    "latest_ranked", "M1 E11 I6 F1 F3",
    s.cte("overall", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS rn FROM overall")
    + f"SELECT station, time, {s.P}, overall_aqi, {s.category('overall_aqi')} AS aqi_category, {s.colour('overall_aqi')} AS aqi_colour FROM r WHERE rn = 1",
    " ".join([*POLLUTANTS, "overall_aqi"]),
)
def _(spark, d):
    from airgrid.plans.merge import average_then_score

    return reports.latest_ranked(average_then_score(feeds.hourly_wide(spark, d)))
