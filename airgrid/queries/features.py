"""Lag, rolling and calendar features, splits and seasonality."""

from pyspark.sql import functions as F

from airgrid.functions import clock
from airgrid.operators import lagging, season
from airgrid.plans import feeds
from airgrid.plans import features as plan
from airgrid.queries import sqlbase as s
from airgrid.queries.gaps import model_gaps, target, target_gaps
from airgrid.queries.registry import query

Y = "overall_aqi"
W = "OVER (PARTITION BY station ORDER BY time"


def named(columns: dict) -> str:
    return " ".join(columns)


_LAGS = {f"{Y}_lag_{k}h": f"lag({Y}, {k}) {W})" for k in (1, 2, 3, 6, 12, 24)}
_DIFFS = {f"{Y}_diff_{k}h": f"{Y} - lag({Y}, {k}) {W})" for k in (1, 24)}


def cells(columns: dict) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


@query("lag_features", "E1 E4 E5", s.cte("target_gaps") + f"SELECT station, time, {cells(_LAGS | _DIFFS)} FROM target_gaps")
def _(spark, d):
    columns = lagging.lags(Y, [1, 2, 3, 6, 12, 24]) | lagging.diffs(Y, [1, 24])
    return target_gaps(spark, d).select("station", "time", *[v.alias(k) for k, v in columns.items()])


@query(
    "weather_lags", "E5",
    s.cte("model_gaps") + "SELECT station, time, " + ", ".join(f"lag({c}, {k}) {W}) AS {c}_lag_{k}h" for c in ("temperature", "humidity") for k in (1, 24)) + " FROM model_gaps",
    "temperature_lag_1h temperature_lag_24h humidity_lag_1h humidity_lag_24h",
)
def _(spark, d):
    columns = lagging.lags("temperature", [1, 24]) | lagging.lags("humidity", [1, 24])
    return model_gaps(spark, d).select("station", "time", *[v.alias(k) for k, v in columns.items()])


def _roll(widths, stats, include: bool) -> dict:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    out = {}
    for w in widths:
        frame = f"{W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" if include else f"{W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for st in stats:
            out[f"{Y}_rolling_{st}_{w}h"] = f"CASE WHEN count({Y}) {frame} = {w} THEN {fn[st]}({Y}) {frame} END"
    return out


_PREV = _roll((3, 6, 12, 24), ("mean", "std", "min", "max"), False)
_INCL = _roll((3, 6, 12, 24, 48, 72), ("mean", "std"), True) | _roll((24,), ("min", "max"), True)


@query("rolling_prev", "E2 S6", s.cte("target_gaps") + f"SELECT station, time, {cells(_PREV)} FROM target_gaps", named(_PREV))
def _(spark, d):
    columns = lagging.rolling(Y, [3, 6, 12, 24])
    return target_gaps(spark, d).select("station", "time", *[v.alias(k) for k, v in columns.items()])


@query("rolling_incl", "E3 S6", s.cte("target") + f"SELECT station, time, {cells(_INCL)} FROM target", named(_INCL))
def _(spark, d):
    columns = lagging.rolling(Y, [3, 6, 12, 24, 48, 72], ("mean", "std"), include_current=True)
    columns |= lagging.rolling(Y, [24], ("min", "max"), include_current=True)
    return target(spark, d).select("station", "time", *[v.alias(k) for k, v in columns.items()])


_CAL = {
    "hour": "CAST(hour(time) AS INTEGER)", "day_of_week": "CAST(isodow(time) - 1 AS INTEGER)", "month": "CAST(month(time) AS INTEGER)",
    "day": "CAST(day(time) AS INTEGER)", "day_of_year": "CAST(dayofyear(time) AS INTEGER)", "is_weekend": "CAST(isodow(time) >= 6 AS INTEGER)",
    "is_morning_rush": "CAST(hour(time) BETWEEN 7 AND 9 AS INTEGER)", "is_evening_rush": "CAST(hour(time) BETWEEN 17 AND 19 AS INTEGER)",
    "is_night": "CAST(hour(time) >= 22 OR hour(time) <= 5 AS INTEGER)", "is_daytime": "CAST(hour(time) >= 6 AND hour(time) < 18 AS INTEGER)",
}
_CYC = {}
for _n, _e, _p in (("hour", "hour(time)", 24), ("day_of_week", "(isodow(time) - 1)", 7), ("month", "month(time)", 12)):
    _CYC[f"{_n}_sin"] = f"sin({_e} * 2 * pi() / {_p})"
    _CYC[f"{_n}_cos"] = f"cos({_e} * 2 * pi() / {_p})"
_CYC |= {"wind_direction_sin": "sin(wind_direction * 2 * pi() / 360)", "wind_direction_cos": "cos(wind_direction * 2 * pi() / 360)"}


@query("calendar_features", "I22 I23 I24 S10", s.cte("weather") + f"SELECT event_id, {cells(_CAL | _CYC)} FROM weather", named(_CYC))
def _(spark, d):
    t = F.col("time")
    columns = clock.calendar(t) | clock.cyclic_calendar(t) | clock.period_flags(t)
    columns["wind_direction_sin"], columns["wind_direction_cos"] = clock.cyclic(F.col("wind_direction"), 360)
    return feeds.weather(spark, d).select("event_id", *[v.alias(k) for k, v in columns.items()])


@query(
    "group_mean_features", "E6",
    s.cte("target") + f"SELECT station, time, avg({Y}) OVER (PARTITION BY station, hour(time)) AS {Y}_hour_avg, avg({Y}) OVER (PARTITION BY station, isodow(time)) AS {Y}_dow_avg FROM target",
    f"{Y}_hour_avg {Y}_dow_avg",
)
def _(spark, d):
    return target(spark, d).select("station", "time", *[v.alias(k) for k, v in lagging.profile_means(Y).items()])


@query(
    "interactions", "I25",
    s.cte("hourly", "wx") + "SELECT h.station, h.time, temperature * hour(h.time) AS temp_hour_interaction, humidity * hour(h.time) AS humidity_hour_interaction, "
    "pm25 / (pm10 + 0.001e0) AS pm25_pm10_ratio FROM hourly h JOIN wx w ON h.station = w.station AND h.time = w.time",
    "temp_hour_interaction humidity_hour_interaction pm25_pm10_ratio",
)
def _(spark, d):
    joined = feeds.hourly_wide(spark, d).join(feeds.hourly_weather_station(spark, d), ["station", "time"])
    hour = F.hour("time")
    return joined.select(
        "station", "time", (F.col("temperature") * hour).alias("temp_hour_interaction"), (F.col("humidity") * hour).alias("humidity_hour_interaction"),
        (F.col("pm25") / (F.col("pm10") + 0.001)).alias("pm25_pm10_ratio"),
    )


@query(
    "direction_of_change", "E18",
    s.cte("target") + f"SELECT station, time, sign({Y} - lag({Y}) {W}))::DOUBLE AS direction FROM target",
)
def _(spark, d):
    return target(spark, d).select("station", "time", lagging.direction(Y).alias("direction"))


@query("skip_first_rows", "E12", s.cte("target", r=f"SELECT *, row_number() {W}) AS rn FROM target") + f"SELECT station, time, {Y} FROM r WHERE rn > 24", Y)
def _(spark, d):
    return lagging.skip_first(target(spark, d), 24)


@query("last_rows", "E19", s.cte("target", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS rn FROM target") + f"SELECT station, time, {Y} FROM r WHERE rn <= 48", Y)
def _(spark, d):
    return lagging.last_rows(target(spark, d), 48)


@query(
    "split_per_station", "E13",
    s.cte("target", r=f"SELECT *, row_number() {W}) AS rn, count(*) OVER (PARTITION BY station) AS n FROM target")
    + "SELECT station, rn <= floor(n * 0.8e0) AS is_train, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM r GROUP BY 1, 2",
)
def _(spark, d):
    return lagging.split_per_key(target(spark, d)).groupBy("station", "is_train").agg(
        F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


@query(
    "split_at_time", "E14 S32",
    s.cte("hourly", h="SELECT time, count(*) AS c FROM hourly GROUP BY 1", u="SELECT time, sum(c) OVER (ORDER BY time) AS upto, sum(c) OVER () AS total FROM h",
          cut="SELECT max(time) AS cut FROM u WHERE upto <= floor(total * 0.8e0)")
    + "SELECT station, time, time <= cut AS is_train FROM hourly, cut",
)
def _(spark, d):
    return lagging.split_at_time(feeds.hourly_wide(spark, d)).select("station", "time", "is_train")


@query(
    "expanding_folds", "J10 S27",
    s.cte("hourly", p="SELECT station, time, row_number() OVER (ORDER BY time, station) - 1 AS pos, count(*) OVER () AS n FROM hourly")
    + "SELECT station, time, CAST(CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS fold FROM p",
)
def _(spark, d):
    return lagging.expanding_folds(feeds.hourly_wide(spark, d)).select("station", "time", "fold")


_TREND = (
    f"SELECT station, time, {Y}, (row_number() {W}) - 1) % 24 AS phase, CASE WHEN lag({Y}, 12) {W}) IS NOT NULL AND lead({Y}, 12) {W}) IS NOT NULL THEN "
    f"(sum({Y}) {W} ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) + (lag({Y}, 12) {W}) + lead({Y}, 12) {W})) / 2) / 24 END AS trend FROM target"
)
_PHASE = "SELECT station, phase, p - avg(p) OVER (PARTITION BY station) AS seasonal FROM (SELECT station, phase, avg({y} - trend) AS p FROM tr GROUP BY 1, 2)"


@query(
    "decompose_24", "E15 S25",
    s.cte("target", tr=_TREND, ph=_PHASE.format(y=Y))
    + f"SELECT tr.station, time, trend AS {Y}_trend, seasonal AS {Y}_seasonal, {Y} - trend - seasonal AS {Y}_resid FROM tr JOIN ph ON tr.station = ph.station AND tr.phase = ph.phase",
    f"{Y}_trend {Y}_seasonal {Y}_resid",
)
def _(spark, d):
    return season.decompose(target(spark, d), Y).drop(Y)


@query(
    "acf_48", "E16",
    s.cte("target", c=f"SELECT station, time, {Y} - avg({Y}) OVER (PARTITION BY station) AS c FROM target",
          l="SELECT a.station, range AS lag, (SELECT 0) AS z, c, lag(c, 0) OVER (PARTITION BY a.station, range ORDER BY time) AS c0, lag(c, CAST(range AS INTEGER)) OVER (PARTITION BY a.station, range ORDER BY time) AS cl FROM c a, range(49)")
    + "SELECT station, CAST(lag AS INTEGER) AS lag, sum(c * cl) / sum(c * c) AS acf FROM l GROUP BY 1, 2", "acf",
)
def _(spark, d):
    return season.acf(target(spark, d), Y, 48)


_ACF_LIST = (
    s.cte("target", c=f"SELECT station, time, {Y} - avg({Y}) OVER (PARTITION BY station) AS c FROM target",
          l="SELECT a.station, range AS lag, c, lag(c, CAST(range AS INTEGER)) OVER (PARTITION BY a.station, range ORDER BY time) AS cl FROM c a, range(49)",
          r="SELECT station, lag, sum(c * cl) / sum(c * c) AS acf FROM l GROUP BY 1, 2",
          rho="SELECT station, list(acf ORDER BY lag) AS r FROM r GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1)
)


@query(
    "pacf_48", "E17",
    # One order more in each round: the new coefficient, then the others corrected by it.
    _ACF_LIST + ", steps AS (SELECT station, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1e0 AS p FROM rho UNION ALL "
    "SELECT station, r, k + 1, list_append([phi[j] - q * phi[k + 1 - j] FOR j IN range(1, k + 1)], q), q FROM (SELECT *, "
    "(r[k + 2] - coalesce(list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]), 0)) / (1 - coalesce(list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)]), 0)) AS q FROM steps WHERE k < 48)) "
    "SELECT station, CAST(k AS INTEGER) AS lag, p AS pacf FROM steps", "pacf",
)
def _(spark, d):
    return season.pacf(target(spark, d), Y, 48)


@query(
    "df_unit_root", "J17",
    s.cte("target", st=f"SELECT station, lag({Y}) {W}) AS x, {Y} - lag({Y}) {W}) AS y FROM target",
          g="SELECT station, CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM st GROUP BY 1",
          t="SELECT station, n, slope, slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) AS t_stat FROM g")
    + "SELECT *, t_stat < -2.862e0 AS is_stationary, CASE WHEN t_stat < -2.862e0 THEN 0 ELSE 1 END AS d FROM t", "slope t_stat",
)
def _(spark, d):
    return season.differencing_order(season.unit_root(target(spark, d), Y))


_POOLED = {f"{Y}_lag_24h": _LAGS[f"{Y}_lag_24h"], f"{Y}_rolling_mean_24h": _PREV[f"{Y}_rolling_mean_24h"], f"{Y}_rolling_std_6h": _PREV[f"{Y}_rolling_std_6h"],
           f"{Y}_diff_24h": f"lag({Y}, 1) {W}) - lag({Y}, 25) {W})"}


@query(
    "pooled_features", "E1 E2 E4 E12 H7 S24",
    s.cte("target", b=f"SELECT station, time, {Y}, row_number() {W}) AS rn, {cells(_POOLED)} FROM target")
    + f"SELECT station, time, {Y}, CAST(hour(time) AS INTEGER) AS hour, {Y}_lag_24h, {Y}_rolling_mean_24h, {Y}_rolling_std_6h, coalesce({Y}_diff_24h, 0e0) AS {Y}_diff_24h FROM b WHERE rn > 24",
    named(_POOLED) + f" {Y}",
)
def _(spark, d):
    return plan.pooled(target(spark, d)).select("station", "time", Y, "hour", *_POOLED)


_EXT = {f"{Y}_lag_168h": f"lag({Y}, 168) {W})", f"{Y}_rolling_mean_72h": _roll((72,), ("mean",), True)[f"{Y}_rolling_mean_72h"], f"{Y}_diff_24h": _DIFFS[f"{Y}_diff_24h"],
        f"{Y}_hour_avg": f"avg({Y}) OVER (PARTITION BY station, hour(time))"}


@query(
    "extended_features", "E1 E3 E4 E6 E15 I24 B16 S24",
    s.cte("target", tr=_TREND, ph=_PHASE.format(y=Y), b=f"SELECT station, time, {Y}, {cells(_EXT)} FROM target")
    + f"SELECT b.*, trend AS {Y}_trend, seasonal AS {Y}_seasonal, CAST(hour(b.time) >= 22 OR hour(b.time) <= 5 AS INTEGER) AS is_night FROM b JOIN tr ON b.station = tr.station AND b.time = tr.time "
    f"JOIN ph ON tr.station = ph.station AND tr.phase = ph.phase WHERE {Y}_lag_168h IS NOT NULL AND trend IS NOT NULL",
    named(_EXT) + f" {Y} {Y}_trend {Y}_seasonal",
)
def _(spark, d):
    return plan.extended(target(spark, d), leakage_safe=False).select("station", "time", Y, *_EXT, f"{Y}_trend", f"{Y}_seasonal", "is_night")
