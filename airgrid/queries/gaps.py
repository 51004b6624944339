"""Hour grids, filling, imputation policies and outliers."""

from pyspark.sql import functions as F

from airgrid.operators import fill, grid, outliers, reshape
from airgrid.plans import feeds
from airgrid.plans.features import prepare, prepare_per_station, with_overall
from airgrid.plans.merge import average_then_score, carry_raw
from airgrid.queries import sqlbase as s
from airgrid.queries.registry import query
from airgrid.schema import POLLUTANTS, WEATHER_NUMERIC

M = feeds.MEASURED
MS = " ".join(M)
ML = ", ".join(M)


def gaps(spark, d):
    return grid.expose_gaps(feeds.hourly_wide(spark, d))


def target_gaps(spark, d):
    scored = with_overall(average_then_score(feeds.hourly_wide(spark, d)))
    return grid.expose_gaps(scored.select("station", "time", "overall_aqi"))


def model_gaps(spark, d):
    return target_gaps(spark, d).join(feeds.hourly_weather_station(spark, d), ["station", "time"], "left")


def target(spark, d):
    return fill.interpolate(target_gaps(spark, d), ["overall_aqi"], by="time", edges="both")


@query("hour_grid", "G5 C7", s.cte("gaps") + f"SELECT station, time, {ML} FROM gaps", MS)
def _(spark, d):
    return gaps(spark, d).select("station", "time", *M)


@query(
    "joint_hour_grid", "G6",
    "WITH a AS (SELECT ts AS time FROM events WHERE event_type = 'error'), b AS (SELECT ts + INTERVAL 7 HOUR AS time FROM events WHERE event_type = 'click') "
    "SELECT unnest(generate_series(date_trunc('hour', least((SELECT min(time) FROM a), (SELECT min(time) FROM b))), "
    "date_trunc('hour', greatest((SELECT max(time) FROM a), (SELECT max(time) FROM b))), INTERVAL 1 HOUR)) AS time",
)
def _(spark, d):
    r = feeds.readings(spark, d)
    a = r.where("parameter = 'pm25'")
    b = r.where("parameter = 'pm10'").withColumn("time", F.col("time") + F.expr("INTERVAL 7 HOURS"))
    return grid.joint_hours(a, b)


@query(
    "resample_hourly", "G7",
    s.cte("weather", h="SELECT station, date_trunc('hour', time) AS time, avg(wind_speed) AS wind_speed, avg(dew) AS dew, arg_min(weather_icon, (time, event_id)) AS weather_icon FROM weather GROUP BY 1, 2",
          g="SELECT station, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM h GROUP BY 1")
    + "SELECT g.station, g.time, wind_speed, dew, weather_icon FROM g LEFT JOIN h ON g.station = h.station AND g.time = h.time", "wind_speed dew",
)
def _(spark, d):
    return grid.resample_hourly(feeds.weather(spark, d), ["wind_speed", "dew"], ["weather_icon"], order=["event_id"])


@query("interpolate_linear", "E8", s.cte("gaps", o=s.interpolated("gaps", M)) + f"SELECT station, time, {ML} FROM o", MS)
def _(spark, d):
    return fill.interpolate(gaps(spark, d), M).select("station", "time", *M)


@query("interpolate_time", "E9", s.cte("hourly", o=s.interpolated("hourly", M, by="time")) + f"SELECT station, time, {ML} FROM o", MS)
def _(spark, d):
    return fill.interpolate(feeds.hourly_wide(spark, d), M, by="time").select("station", "time", *M)


@query(
    "interpolate_limit", "E10",
    s.cte("gaps", o=s.interpolated("gaps", M, edges="forward", limit=2)) + f"SELECT station, time, {ML} FROM o", MS,
)
def _(spark, d):
    return fill.interpolate(gaps(spark, d), M, edges="forward", limit=2).select("station", "time", *M)


def _carried(c: str, first: str, then: str | None) -> str:
    back = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"first_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    order = {"b": back, "a": ahead}
    return f"coalesce({', '.join([order[first]] + ([order[then]] if then else []))}) AS {c}"


@query("ffill_bfill", "E7 H9", s.cte("gaps") + f"SELECT station, time, {', '.join(_carried(c, 'b', 'a') for c in M)} FROM gaps", MS)
def _(spark, d):
    return fill.carry(gaps(spark, d), M).select("station", "time", *M)


_RAW_PART = "PARTITION BY station ORDER BY time, event_id ROWS BETWEEN"


@query(
    "carry_raw_rows", "E7 O2",
    s.cte("weather") + "SELECT event_id, "
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_RAW_PART} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({_RAW_PART} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in ("temperature", "pressure")
    ) + " FROM weather", "temperature pressure",
)
def _(spark, d):
    return carry_raw(feeds.weather(spark, d), ["temperature", "pressure"], ["event_id"]).select("event_id", "temperature", "pressure")


@query(
    "winsorize_global", "B21 C10",
    s.cte("raw_wide", q="SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in M) + " FROM raw_wide")
    + "SELECT event_id, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_hi + 3 * ({c}_hi - {c}_lo)), {c}_lo - 3 * ({c}_hi - {c}_lo)) END AS {c}" for c in M)
    + " FROM raw_wide, q", MS,
)
def _(spark, d):
    return outliers.winsorize_global(feeds.raw_wide(spark, d), M).select("event_id", *M)


@query(
    "winsorize_tight", "B21 B26",
    s.cte("raw_wide", q="SELECT " + ", ".join(f"quantile_cont({c}, 0.1) AS {c}_lo, quantile_cont({c}, 0.9) AS {c}_hi" for c in M) + " FROM raw_wide")
    + "SELECT event_id, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_hi + 0.25 * ({c}_hi - {c}_lo)), {c}_lo - 0.25 * ({c}_hi - {c}_lo)) END AS {c}" for c in M)
    + " FROM raw_wide, q", MS,
)
def _(spark, d):
    return outliers.winsorize_global(feeds.raw_wide(spark, d), M, 0.1, 0.9, 0.25).select("event_id", *M)


_WX = ["temperature", "pressure", "wind_speed"]
_FENCE = s.cte(
    "wx",
    q="SELECT station, " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _WX) + " FROM wx GROUP BY 1",
    f="SELECT station, " + ", ".join(f"{c}_1 - 1.5 * ({c}_3 - {c}_1) AS {c}_low, {c}_3 + 1.5 * ({c}_3 - {c}_1) AS {c}_high" for c in _WX) + " FROM q",
    j="SELECT w.station, w.time, " + ", ".join(f"{c}, {c}_low, {c}_high" for c in _WX) + " FROM wx w JOIN f ON w.station = f.station",
)


def _cap(c: str) -> str:
    skip = f" AND NOT {c}_low < 0" if c in ("temperature", "pressure", "wind_direction") else ""
    return f"CASE WHEN {c} > {c}_high THEN {c}_high WHEN {c} < {c}_low{skip} THEN {c}_low ELSE {c} END"


@query("winsorize_iqr", "B22", _FENCE + "SELECT station, time, " + ", ".join(f"{_cap(c)} AS {c}" for c in _WX) + " FROM j", " ".join(_WX))
def _(spark, d):
    return outliers.winsorize_iqr(feeds.hourly_weather_station(spark, d), _WX).select("station", "time", *_WX)


@query(
    "outlier_report", "B23 O4",
    _FENCE + " UNION ALL ".join(
        f"SELECT station, '{c}' AS \"column\", count(CASE WHEN {c} > {c}_high OR {c} < {c}_low THEN 1 END) AS n_outliers, "
        f"count(CASE WHEN {c} > {c}_high OR {c} < {c}_low THEN 1 END) * 100e0 / count(*) AS pct, min({c}) AS min_before, max({c}) AS max_before, "
        f"min({_cap(c)}) AS min_after, max({_cap(c)}) AS max_after FROM j GROUP BY station" for c in _WX
    ), "pct min_before max_before min_after max_after",
)
def _(spark, d):
    return outliers.outlier_report(feeds.hourly_weather_station(spark, d), _WX)


@query("extreme_events", "B24", s.cte("overall") + "SELECT station, time, overall_aqi, CASE WHEN overall_aqi > 250 THEN 1 ELSE 0 END AS is_extreme_event FROM overall")
def _(spark, d):
    scored = with_overall(average_then_score(feeds.hourly_wide(spark, d))).select("station", "time", "overall_aqi")
    return outliers.flag_extreme(scored)


_NEAR = "OVER (PARTITION BY station ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(
    "clean_training_series", "B25",
    s.cte("target", b="SELECT station, greatest(0, min(overall_aqi) - 2 * stddev_pop(overall_aqi)) AS low, quantile_cont(overall_aqi, 0.5) + 0 AS med, "
          "max(overall_aqi) + 3 * stddev_pop(overall_aqi) AS high, avg(overall_aqi) AS mean FROM (SELECT * FROM target WHERE time < TIMESTAMP '2024-01-08') GROUP BY 1",
          w=f"SELECT t.station, t.time, overall_aqi AS x, low, high, mean, median(overall_aqi) {_NEAR} AS near, "
          "lag(overall_aqi) OVER (PARTITION BY t.station ORDER BY t.time) AS before, lead(overall_aqi) OVER (PARTITION BY t.station ORDER BY t.time) AS after "
          "FROM target t JOIN b ON t.station = b.station".replace("PARTITION BY station", "PARTITION BY t.station"))
    + "SELECT station, time, CASE WHEN x > high OR x < low THEN CASE WHEN before IS NULL OR after IS NULL THEN mean ELSE near END ELSE x END AS overall_aqi FROM w",
    "overall_aqi",
)
def _(spark, d):
    series = target(spark, d)
    first_week = series.where(F.col("time") < F.lit("2024-01-08").cast("timestamp_ntz"))
    return outliers.clean_training_series(series, first_week, "overall_aqi").select("station", "time", "overall_aqi")


_SPIKED = "SELECT station, time, CASE WHEN row_number() OVER (PARTITION BY station ORDER BY time) % 37 = 1 AND time >= TIMESTAMP '2024-01-08' OR row_number() OVER (PARTITION BY station ORDER BY time DESC) = 1 THEN overall_aqi * 10 + 1000 ELSE overall_aqi END AS x FROM target"


@query(
    "clean_training_spikes", "B25 B26",
    s.cte("target", sp=_SPIKED,
          b="SELECT station, greatest(0, min(x) - 2 * stddev_pop(x)) AS low, max(x) + 3 * stddev_pop(x) AS high, avg(x) AS mean FROM sp WHERE time < TIMESTAMP '2024-01-08' GROUP BY 1",
          w="SELECT t.station, t.time, x, low, high, mean, median(x) OVER (PARTITION BY t.station ORDER BY t.time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, "
            "lag(x) OVER (PARTITION BY t.station ORDER BY t.time) AS before, lead(x) OVER (PARTITION BY t.station ORDER BY t.time) AS after FROM sp t JOIN b ON t.station = b.station")
    + "SELECT station, time, x AS spiked, CASE WHEN x > high OR x < low THEN CASE WHEN before IS NULL OR after IS NULL THEN mean ELSE near END ELSE x END AS overall_aqi FROM w",
    "spiked overall_aqi",
)
def _(spark, d):
    """Every 37th value after the first week, and the last of each station, lies far outside and is repaired."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("station").orderBy("time")
    late = F.col("time") >= F.lit("2024-01-08").cast("timestamp_ntz")
    last = F.row_number().over(Window.partitionBy("station").orderBy(F.desc("time"))) == 1
    spike = ((F.row_number().over(by_time) % 37 == 1) & late) | last
    series = target(spark, d).withColumn("spiked", F.when(spike, F.col("overall_aqi") * 10 + 1000).otherwise(F.col("overall_aqi")))
    series = series.withColumn("overall_aqi", F.col("spiked"))
    return outliers.clean_training_series(series, series.where(~late), "overall_aqi").select("station", "time", "spiked", "overall_aqi")


@query(
    "median_fill", "H1 D16",
    s.cte("hourly", m="SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in M) + " FROM hourly")
    + "SELECT station, time, " + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in M) + " FROM hourly, m", MS,
)
def _(spark, d):
    return fill.fill_median(feeds.hourly_wide(spark, d), M).select("station", "time", *M)


@query(
    "mean_mode_fill", "H2 H10 B9",
    s.cte("weather", t="SELECT event_id, temperature, CASE WHEN pressure IS NOT NULL THEN weather_icon END AS icon FROM weather")
    + "SELECT event_id, coalesce(temperature, (SELECT avg(temperature) FROM t)) AS temperature, "
    "coalesce(icon, (SELECT icon FROM t WHERE icon IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS icon, coalesce(icon, 'unknown') AS icon_or_unknown FROM t",
    "temperature",
)
def _(spark, d):
    icon = F.when(F.col("pressure").isNotNull(), F.col("weather_icon"))
    t = feeds.weather(spark, d).select("event_id", "temperature", icon.alias("icon"), icon.alias("icon_or_unknown"))
    return fill.fill_category(fill.fill_mean_mode(t, ["temperature"], ["icon"]), icon_or_unknown="unknown")


@query(
    "station_mode_fill", "H3",
    s.cte("model_gaps", m=s.mode("m_icon", "model_gaps", "station", "weather_icon"))
    + "SELECT g.station, g.time, coalesce(weather_icon, m_icon) AS weather_icon FROM model_gaps g LEFT JOIN m ON g.station = m.station",
)
def _(spark, d):
    return fill.fill_key_mode(model_gaps(spark, d), "weather_icon").select("station", "time", "weather_icon")


def _tier(c: str) -> str:
    return (
        f"CASE WHEN share_{c} > 0.5 THEN NULL WHEN share_{c} >= 0.1 THEN coalesce(g.{c}, mean_{c}) ELSE i.{c} END AS {c}"
    )


_TIERED = [*M, "wind_speed"]


@query(
    "tiered_impute", "H4 D25",
    s.cte(
        "gaps", "wx",
        t=f"SELECT g.station, g.time, {ML}, wind_speed FROM gaps g LEFT JOIN wx w ON g.station = w.station AND g.time = w.time",
        i=s.interpolated("t", _TIERED, by="time"),
        st="SELECT station, " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS share_{c}, avg({c}) AS mean_{c}" for c in _TIERED) + " FROM t GROUP BY 1",
    )
    + "SELECT g.station, g.time, " + ", ".join(_tier(c) for c in _TIERED) + " FROM t g JOIN i ON g.station = i.station AND g.time = i.time JOIN st ON g.station = st.station",
    " ".join(_TIERED),
)
def _(spark, d):
    t = gaps(spark, d).join(feeds.hourly_weather_station(spark, d).select("station", "time", "wind_speed"), ["station", "time"], "left")
    return fill.fill_by_tier(t, _TIERED).select("station", "time", *_TIERED)


@query(
    "cascade_impute", "H5 H8",
    s.cte("gaps", m="SELECT station, " + ", ".join(f"avg({c}) AS m_{c}" for c in POLLUTANTS) + " FROM gaps GROUP BY 1",
          o="SELECT " + ", ".join(f"avg({c}) AS o_{c}" for c in POLLUTANTS) + " FROM gaps")
    + "SELECT g.station, g.time, " + ", ".join(f"coalesce({c}, m_{c}, o_{c}, 0e0) AS {c}" for c in POLLUTANTS) + " FROM gaps g JOIN m ON g.station = m.station, o",
    " ".join(POLLUTANTS),
)
def _(spark, d):
    return fill.fill_cascade(gaps(spark, d), POLLUTANTS).select("station", "time", *POLLUTANTS)


_HUB = s.cte("wx", hub=f"SELECT time, {s.WN}, weather_icon FROM wx WHERE station = 'S0'",
             hours="SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM wx",
             raw=f"SELECT h.time, {s.WN}, weather_icon FROM hours h LEFT JOIN hub ON h.time = hub.time",
             i=s.interpolated("raw", WEATHER_NUMERIC, key=""))


@query(
    "weather_series", "H6 E8",
    _HUB + f"SELECT time, {s.WN}, coalesce(last_value(weather_icon IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(weather_icon IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS weather_icon FROM i",
    " ".join(WEATHER_NUMERIC),
)
def _(spark, d):
    wx = feeds.hourly_weather_station(spark, d)
    hours = grid.joint_hours(wx, wx)
    hub = wx.where(F.col("station") == feeds.HUB).drop("station")
    return fill.fill_weather(hours.join(hub, "time", "left"), WEATHER_NUMERIC, "weather_icon")


@query(
    "target_feature_fill", "H9",
    s.cte("model_gaps", i=s.interpolated("model_gaps", ["temperature", "humidity"]))
    + f"SELECT station, time, {_carried('overall_aqi', 'b', 'a')}, temperature, humidity FROM i", "temperature humidity",
)
def _(spark, d):
    return fill.fill_target_and_features(
        model_gaps(spark, d).select("station", "time", "overall_aqi", "temperature", "humidity"), "overall_aqi", ["temperature", "humidity"]
    )


@query(
    "prepared_frame", "B15 B21 H3 H5 E9",
    s.cte(
        "model_gaps",
        q="SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in ["overall_aqi", "wind_speed"]) + " FROM model_gaps",
        w="SELECT station, time, weather_icon, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_hi + 3 * ({c}_hi - {c}_lo)), {c}_lo - 3 * ({c}_hi - {c}_lo)) END AS {c}" for c in ["overall_aqi", "wind_speed"]) + " FROM model_gaps, q",
        i=s.interpolated("w", ["overall_aqi", "wind_speed"], by="time"),
        m=s.mode("m_icon", "model_gaps", "station", "weather_icon"),
    ) + "SELECT i.station, i.time, overall_aqi, wind_speed, coalesce(weather_icon, m_icon) AS weather_icon FROM i JOIN m ON i.station = m.station",
    "overall_aqi wind_speed",
)
def _(spark, d):
    frame = model_gaps(spark, d).select("station", "time", "overall_aqi", "wind_speed", "weather_icon")
    return prepare(frame, ["overall_aqi", "wind_speed"])


@query(
    "prepared_per_station", "H4 B22 B24",
    s.cte(
        "model_gaps",
        i=s.interpolated("model_gaps", ["overall_aqi"], by="time"),
        st="SELECT station, avg(CASE WHEN overall_aqi IS NULL THEN 1e0 ELSE 0e0 END) AS share, avg(overall_aqi) AS mean, avg(CASE WHEN weather_icon IS NULL THEN 1e0 ELSE 0e0 END) AS icon_share FROM model_gaps GROUP BY 1",
        m=s.mode("m_icon", "model_gaps", "station", "weather_icon"),
        t="SELECT g.station, g.time, CASE WHEN share > 0.5 THEN NULL WHEN share >= 0.1 THEN coalesce(g.overall_aqi, mean) ELSE i.overall_aqi END AS x, "
        "CASE WHEN icon_share <= 0.5 THEN coalesce(g.weather_icon, m_icon) END AS weather_icon FROM model_gaps g JOIN i ON g.station = i.station AND g.time = i.time "
        "JOIN st ON g.station = st.station JOIN m ON g.station = m.station",
        q="SELECT station, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM t GROUP BY 1",
        c="SELECT t.station, time, weather_icon, CASE WHEN x > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) WHEN x < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) ELSE x END AS overall_aqi FROM t JOIN q ON t.station = q.station",
    ) + "SELECT *, CASE WHEN overall_aqi > 250 THEN 1 ELSE 0 END AS is_extreme_event FROM c", "overall_aqi",
)
def _(spark, d):
    frame = model_gaps(spark, d).select("station", "time", "overall_aqi", "weather_icon")
    return prepare_per_station(frame, ["overall_aqi"])


@query(
    "long_to_wide_first", "G2 B8 B20 S33",
    s.cte("readings", r="SELECT *, row_number() OVER (PARTITION BY station, date_trunc('hour', time), parameter ORDER BY time, event_id) AS rn FROM readings")
    + "SELECT station, date_trunc('hour', time) AS time, " + ", ".join(f"max(CASE WHEN parameter = '{p}' AND rn = 1 THEN value END) AS {p}" for p in POLLUTANTS)
    + " FROM r GROUP BY 1, 2",
)
def _(spark, d):
    from airgrid.functions.clock import floor_to

    r = feeds.readings(spark, d)
    loud = F.when(F.col("parameter") == "pm25", "PM2.5").when(F.col("parameter") == "pm10", "pm_10").otherwise(F.upper("parameter"))
    named = r.withColumns({"parameter": reshape.canonical_parameter(loud), "hour": floor_to(F.col("time"))})
    wide = reshape.long_to_wide(named, ["station", "hour"], "parameter", "value", ["time", "event_id"])
    return reshape.ensure_columns(wide, POLLUTANTS).withColumnRenamed("hour", "time").select("station", "time", *POLLUTANTS)


@query(
    "one_hot_station", "G4",
    s.cte("readings") + "SELECT event_id, " + ", ".join(f"CASE WHEN station = 'S{i}' THEN 1 ELSE 0 END AS station_S{i}" for i in range(5))
    + ", " + ", ".join(f"CASE WHEN parameter = '{p}' THEN 1 ELSE 0 END AS parameter_{p}" for p in sorted(M)[1:]) + " FROM readings",
)
def _(spark, d):
    r = feeds.readings(spark, d)
    coded = reshape.one_hot(r, "station", reshape.levels(r, "station"))
    coded = reshape.one_hot(coded, "parameter", reshape.levels(r, "parameter"), drop_first=True)
    return coded.drop("station", "time", "parameter", "value")


@query("future_grid", "G8", s.cte("hourly", l="SELECT station, max(time) AS last FROM hourly GROUP BY 1")
       + "SELECT station, last + (range * INTERVAL 1 HOUR) AS time, CAST(range AS INTEGER) AS horizon FROM l, range(1, 25)")
def _(spark, d):
    return grid.future_hours(feeds.hourly_wide(spark, d), 24)
