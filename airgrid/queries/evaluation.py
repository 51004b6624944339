"""Forecast quality and set-based forecasts, with the previous hour's value as the prediction."""

from pyspark.sql import functions as F

from airgrid.functions.scales import category
from airgrid.operators import evaluate, lagging
from airgrid.plans import forecasting
from airgrid.queries import sqlbase as s
from airgrid.queries.gaps import target
from airgrid.queries.registry import query

Y = "overall_aqi"
_PRED = f"SELECT station, time, {Y} AS y, lag({Y}) OVER (PARTITION BY station ORDER BY time) AS p FROM target"
BASE = s.cte("target", pred=_PRED, known="SELECT * FROM pred WHERE p IS NOT NULL")


def predicted(spark, d):
    series = target(spark, d)
    return series.select("station", "time", F.col(Y).alias("y"), lagging.lags(Y, [1])[f"{Y}_lag_1h"].alias("p"))


_METRICS = (
    "count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / regr_syy(y, y) AS r2, "
    f"avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 AS mape, avg(CASE WHEN {s.category('y')} = {s.category('p')} THEN 1e0 ELSE 0e0 END) * 100 AS category_accuracy"
)
_MN = "mae rmse r2 mape category_accuracy"


@query("metrics", "L1 L2 L3", BASE + f"SELECT {_METRICS} FROM known", _MN)
def _(spark, d):
    return evaluate.metrics(predicted(spark, d))


@query("metrics_per_station", "L7", BASE + f"SELECT station, {_METRICS} FROM known GROUP BY 1", _MN)
def _(spark, d):
    return evaluate.metrics(predicted(spark, d), keys=["station"])


@query(
    "directional", "L4 E18 S23",
    BASE + "SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) * 100 AS directional_accuracy FROM (SELECT sign(y - lag(y) OVER w) AS a, sign(p - lag(p) OVER w) AS b "
    "FROM pred WINDOW w AS (PARTITION BY station ORDER BY time)) WHERE a IS NOT NULL AND b IS NOT NULL", "directional_accuracy",
)
def _(spark, d):
    return evaluate.directional_accuracy(predicted(spark, d))


@query("category_metrics", "L5", BASE + f"SELECT {s.category('y')} AS category, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM known GROUP BY 1", "mae rmse")
def _(spark, d):
    return evaluate.category_errors(predicted(spark, d))


@query(
    "confusion", "L6",
    s.cte("target", pred=_PRED, known="SELECT * FROM pred WHERE p IS NOT NULL", c=f"SELECT {s.category('y')} AS true_category, {s.category('p')} AS predicted_category, count(*) AS n FROM known GROUP BY 1, 2")
    + "SELECT *, n / sum(n) OVER (PARTITION BY true_category) AS row_share FROM c", "row_share",
)
def _(spark, d):
    return evaluate.confusion(predicted(spark, d))


@query(
    "error_summary", "L8 S7",
    BASE + "SELECT avg(y - p) AS mean_error, stddev_samp(y - p) AS std_error, min(y - p) AS min_error, max(y - p) AS max_error, avg(abs(y - p)) AS mae FROM known",
    "mean_error std_error min_error max_error mae",
)
def _(spark, d):
    return evaluate.error_summary(predicted(spark, d))


@query("errors_by_hour", "L9", BASE + "SELECT CAST(hour(time) AS INTEGER) AS hour, avg(abs(y - p)) AS mae FROM known GROUP BY 1", "mae")
def _(spark, d):
    return evaluate.errors_by_hour(predicted(spark, d))


@query("errors_by_weekday", "L9", BASE + "SELECT CAST(isodow(time) - 1 AS INTEGER) AS day_of_week, avg(abs(y - p)) AS mae FROM known GROUP BY 1", "mae")
def _(spark, d):
    return evaluate.errors_by_weekday(predicted(spark, d))


@query("largest_errors", "L10 F3", BASE + "SELECT station, time, y, p, y - p AS error, abs(y - p) AS abs_error FROM known ORDER BY round(abs(y - p), 6) DESC, station, time LIMIT 10", "y p error abs_error")
def _(spark, d):
    rounded = evaluate.error_table(predicted(spark, d)).withColumn("abs_error", F.round("abs_error", 6))
    return rounded.orderBy(F.desc_nulls_last("abs_error"), "station", "time").limit(10)


def _models(spark, d):
    """Three simple predictors as 'models': one hour ago, one day ago, mean of the previous day."""
    series = target(spark, d).withColumns(
        lagging.lags(Y, [1, 24]) | lagging.rolling(Y, [24], ("mean",))
    )
    names = {"last_hour": f"{Y}_lag_1h", "last_day": f"{Y}_lag_24h", "day_mean": f"{Y}_rolling_mean_24h"}
    item = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in names.items()]))
    long = series.select("station", "time", F.col(Y).alias("y"), item.alias("m")).select("station", "time", "y", "m.*")
    return evaluate.metrics(long, keys=["model"])


_MODELS = s.cte(
    "target",
    f=f"SELECT station, time, {Y} AS y, lag({Y}) OVER w AS p1, lag({Y}, 24) OVER w AS p24, CASE WHEN count({Y}) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24 THEN avg({Y}) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS m "
      "FROM target WINDOW w AS (PARTITION BY station ORDER BY time)",
    long="SELECT 'last_hour' AS model, y, p1 AS p FROM f UNION ALL SELECT 'last_day', y, p24 FROM f UNION ALL SELECT 'day_mean', y, m FROM f",
    res=f"SELECT model, {_METRICS} FROM long WHERE p IS NOT NULL GROUP BY 1",
)


@query("model_ranking", "L11", _MODELS + "SELECT model, n, mae, rmse, r2, row_number() OVER (ORDER BY rmse, model)::INTEGER AS rank, row_number() OVER (ORDER BY rmse, model) = 1 AS is_best FROM res", "mae rmse r2")
def _(spark, d):
    results = _models(spark, d).withColumn("run", F.lit(1))
    twice = results.unionByName(results.withColumns({"run": F.lit(2), "rmse": F.lit(0.0)}))
    return evaluate.rank_models(twice).drop("run", "mape", "category_accuracy")


@query(
    "metric_normalisation", "I28",
    _MODELS + "SELECT model, 1 - mae / max(mae) OVER () AS mae, 1 - rmse / max(rmse) OVER () AS rmse, (category_accuracy - min(category_accuracy) OVER ()) / (max(category_accuracy) OVER () - min(category_accuracy) OVER ()) AS category_accuracy FROM res",
    "mae rmse category_accuracy",
)
def _(spark, d):
    out = evaluate.normalise_metrics(_models(spark, d), ["mae", "rmse"], ["category_accuracy"])
    return out.select("model", "mae", "rmse", "category_accuracy")


@query(
    "improvement", "L12",
    s.cte("target", pred=_PRED, f="SELECT station, time, y, p, avg(p) OVER (PARTITION BY station ORDER BY time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS q FROM pred",
          b="SELECT station AS model, sqrt(avg((y - p) * (y - p))) AS base, sqrt(avg((y - q) * (y - q))) AS tuned FROM f WHERE p IS NOT NULL GROUP BY 1")
    + "SELECT model, base, tuned, (base - tuned) / base * 100 AS gain_pct FROM b", "base tuned gain_pct",
)
def _(spark, d):
    from pyspark.sql import Window as W

    near = W.partitionBy("station").orderBy("time").rowsBetween(-5, 0)
    frame = predicted(spark, d).withColumn("q", F.avg("p").over(near))
    base = evaluate.metrics(frame, pred="p", keys=["station"]).withColumnRenamed("station", "model")
    tuned = evaluate.metrics(frame.where("p IS NOT NULL"), pred="q", keys=["station"]).withColumnRenamed("station", "model")
    return evaluate.improvement(base, tuned)


_PATTERN = {
    "past": f"SELECT station, time, {Y} AS y, hour(time) AS h, isodow(time) >= 6 AS we, max(time) OVER (PARTITION BY station) AS latest FROM "
            "(SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS rn FROM target) WHERE rn <= 336",
    "wt": "SELECT *, exp(-0.1e0 * (epoch_us(latest) - epoch_us(time)) / 86400000000e0) AS w FROM past",
    "lasts": "SELECT station, max(time) AS last FROM target GROUP BY 1",
    "ahead": "SELECT station, last + (range * INTERVAL 1 HOUR) AS time, CAST(range AS INTEGER) AS horizon, hour(last + (range * INTERVAL 1 HOUR)) AS h, isodow(last + (range * INTERVAL 1 HOUR)) >= 6 AS we FROM lasts, range(1, 25)",
    "hits": "SELECT a.station, a.time, a.horizon, a.we, p.we AS pwe, y, w, count(y) OVER (PARTITION BY a.station, a.horizon) AS n_all FROM ahead a LEFT JOIN wt p ON a.station = p.station AND a.h = p.h",
    "naive": f"SELECT a.station, a.time, a.horizon, t.{Y} AS forecast FROM ahead a LEFT JOIN target t ON a.station = t.station AND t.time = a.time - INTERVAL 24 HOUR",
    "pattern": "SELECT h.station, h.time, h.horizon, coalesce(sum(CASE WHEN n_all < 7 OR h.we = pwe THEN w * y END) / sum(CASE WHEN n_all < 7 OR h.we = pwe THEN w END), max(n.forecast)) AS forecast "
               "FROM hits h JOIN naive n ON h.station = n.station AND h.time = n.time GROUP BY 1, 2, 3",
}


@query("pattern_forecast", "K4 I27", s.cte("target", **_PATTERN) + "SELECT station, time, horizon, forecast FROM pattern", "forecast")
def _(spark, d):
    return forecasting.pattern_forecast(target(spark, d))


@query("seasonal_naive", "K10 G8", s.cte("target", **_PATTERN) + "SELECT station, time, horizon, forecast FROM naive", "forecast")
def _(spark, d):
    return forecasting.seasonal_naive(target(spark, d))


_BLEND = "0.7e0 * n.forecast + 0.3e0 * p.forecast"


@query(
    "blend_interval", "K5 K6 K7",
    s.cte("target", pred=_PRED, m="SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM pred WHERE p IS NOT NULL", **_PATTERN,
          b=f"SELECT n.station, n.time, n.horizon, {_BLEND} AS forecast FROM naive n JOIN pattern p ON n.station = p.station AND n.time = p.time")
    + "SELECT station, time, horizon, forecast, greatest(0, forecast - 1.96e0 * mae * (1 + 0.1e0 * horizon)) AS lower_bound, forecast + 1.96e0 * mae * (1 + 0.1e0 * horizon) AS upper_bound, "
    "greatest(0, forecast - 1.96e0 * rmse) AS lower_rmse, forecast + 1.96e0 * rmse AS upper_rmse FROM b, m",
    "forecast lower_bound upper_bound lower_rmse upper_rmse",
)
def _(spark, d):
    from airgrid.operators.scalars import with_row

    series = target(spark, d)
    mixed = forecasting.blend(forecasting.seasonal_naive(series), forecasting.pattern_forecast(series))
    errors = evaluate.metrics(predicted(spark, d)).select("mae", "rmse")
    with_errors = with_row(mixed, errors, "_err")
    wide = forecasting.interval_rmse(with_errors, F.col("_err")["rmse"]).withColumnsRenamed({"lower_bound": "lower_rmse", "upper_bound": "upper_rmse"})
    out = forecasting.interval_growing(wide, F.col("_err")["mae"])
    return out.select("station", "time", "horizon", "forecast", "lower_bound", "upper_bound", "lower_rmse", "upper_rmse")


@query(
    "forecast_bands", "K11 I7",
    s.cte("target", **_PATTERN) + f"SELECT {s.category('forecast')} AS category, count(*) AS n, avg(forecast + 19.6e0 - greatest(0, forecast - 19.6e0)) AS mean_width FROM pattern GROUP BY 1", "mean_width",
)
def _(spark, d):
    return forecasting.horizon_summary(forecasting.interval_rmse(forecasting.pattern_forecast(target(spark, d)), 10.0))


@query(
    "holdout_check", "K12 E19",
    s.cte("target", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS rn FROM target",
          c=f"SELECT a.station, a.time, a.{Y} AS y, b.{Y} AS p FROM r a JOIN target b ON a.station = b.station AND b.time = a.time - INTERVAL 24 HOUR WHERE a.rn <= 24")
    + "SELECT station, count(*) AS n, avg(abs(y - p)) AS mae FROM c GROUP BY 1", "mae",
)
def _(spark, d):
    past, truth = forecasting.holdout(target(spark, d), 24)
    made = forecasting.seasonal_naive(past, steps=24)
    joined = truth.join(made, ["station", "time"]).select("station", F.col(Y).alias("y"), F.col("forecast").alias("p"))
    return evaluate.metrics(joined, keys=["station"]).select("station", "n", "mae")


@query("forecast_categories", "I7", s.cte("target") + f"SELECT station, time, {s.category(Y)} AS category FROM target")
def _(spark, d):
    return target(spark, d).select("station", "time", category(F.col(Y)).alias("category"))
