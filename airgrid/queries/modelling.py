"""Model fitting, tuning, clustering and model-based forecasts on the hourly target series."""

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from airgrid.functions import icons
from airgrid.functions.rows import clip
from airgrid.operators import evaluate, lagging, season
from airgrid.operators.outliers import clean_training_series, training_bounds
from airgrid.plans import clusters, feeds, forecasting, station_models, training
from airgrid.plans import features as plan
from airgrid.queries import sqlbase as s
from airgrid.queries.gaps import model_gaps, target
from airgrid.queries.registry import REGISTRY, query
from airgrid.schema import WEATHER_NUMERIC
from airgrid.session import cut_lineage

Y = plan.TARGET


def prepared(spark, d):
    """Filled hourly frame: target, weather, icon."""
    return cut_lineage(plan.prepare(model_gaps(spark, d), [Y, *WEATHER_NUMERIC]))


CATEGORIES = ["station", "weather"]


def dataset(spark, d):
    """(feature frame with ``is_train``, numeric feature names, filled history). Station and weather stay categories,
    which the models encode as sparse vectors, so any number of stations will do."""
    history = prepared(spark, d)
    built = plan.pooled(history).withColumn("weather", icons.icon_code(F.col("weather_icon")))
    frame = cut_lineage(lagging.split_per_key(built))
    return frame, plan.feature_columns(frame), history


def _split(frame):
    return frame.where("is_train"), frame.where("NOT is_train")


@query("model_compare", "J1 J2 J3 J4 J5 J6 J7 J8 J12 H11 L1 L7 L11")
def _(spark, d):
    """Every model at its usual settings, ranked by RMSE on the held-out last fifth of each station."""
    frame, columns, _ = dataset(spark, d)
    train, test = _split(frame)
    models = training.fit_models(train, columns, categories=CATEGORIES)
    return evaluate.rank_models(training.compare(models, test, columns).withColumn("run", F.lit(1)))


@query("feature_importance", "J9 F3")
def _(spark, d):
    frame, columns, _ = dataset(spark, d)
    models = training.fit_models(_split(frame)[0], columns, ["random_forest"], with_ridge=False, categories=CATEGORIES)
    return training.importances(models["random_forest"], columns, spark, 15)


@query("grid_search", "J10 L12")
def _(spark, d):
    """A random forest tuned over expanding time folds."""
    frame, columns, _ = dataset(spark, d)

    def make(maxDepth, numTrees):
        return RandomForestRegressor(
            labelCol=Y, featuresCol="features", predictionCol="raw_prediction", maxDepth=maxDepth, numTrees=numTrees, seed=training.SEED
        )

    results = training.grid_search(frame.where("is_train"), columns, make, {"maxDepth": [5, 10], "numTrees": [20, 50]}, categories=CATEGORIES)
    rows = [(r["params"]["maxDepth"], r["params"]["numTrees"], r["rmse"], i + 1) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "max_depth INT, num_trees INT, rmse DOUBLE, rank INT")


@query("station_importance", "J9 J12")
def _(spark, d):
    """How much the single stations matter to a pooled forest."""
    frame, columns, _ = dataset(spark, d)
    models = training.fit_models(_split(frame)[0], columns, ["random_forest"], with_ridge=False, categories=CATEGORIES)
    return training.importances(models["random_forest"], columns, spark, of="station")


@query("tuned_boosting", "J10 J6 J7 L12")
def _(spark, d):
    """Boosted models halved over time folds; the best one, stopped early, against the usual settings on the held-out rows."""
    frame, columns, _ = dataset(spark, d)
    train, test = _split(frame)
    results = training.tune_boosted(train, columns, categories=CATEGORIES)
    best, used = training.fit_boosted(train, columns, results[0]["params"], categories=CATEGORIES)
    usual = training.estimators(Y)["gradient_boosting"]
    base = training.fit_prepared(train, columns, usual, CATEGORIES)
    both = training.compare({"tuned": best, "base": base}, test, columns).select("model", "rmse")
    rows = [(f"stage {r['stage']}", r["rounds"], r["params"]["maxDepth"], r["params"]["stepSize"], r["rank"], r["rmse"]) for r in results]
    final = {"tuned": (used, *results[0]["params"].values()), "base": (usual.getMaxIter(), usual.getMaxDepth(), usual.getStepSize())}
    rows += [(r.model, *final[r.model], 1, r.rmse) for r in both.collect()]
    return spark.createDataFrame(rows, "name STRING, rounds INT, max_depth INT, step_size DOUBLE, rank INT, rmse DOUBLE")


@query("recursive_forecast", "K1 K2 K9 J12")
def _(spark, d):
    frame, columns, history = dataset(spark, d)
    model = training.fit_models(frame, columns, ["linear"], with_ridge=False, categories=CATEGORIES)["linear"]
    return forecasting.recursive_forecast(model, history, columns, 24, categories=CATEGORIES)


@query("blended_forecast", "K1 K4 K5 K6 K11 K12")
def _(spark, d):
    """Recursive and pattern forecasts blended, with intervals that grow with the horizon."""
    frame, columns, history = dataset(spark, d)
    train, test = _split(frame)
    model = training.fit_models(train, columns, ["linear"], with_ridge=False, categories=CATEGORIES)["linear"]
    mae = training.compare({"linear": model}, test, columns).first()["mae"]
    made = forecasting.blend(
        forecasting.recursive_forecast(model, history, columns, 24, categories=CATEGORIES), forecasting.pattern_forecast(history)
    )
    return forecasting.interval_growing(made, mae)


@query("tree_intervals", "K8 J5")
def _(spark, d):
    frame, columns, _ = dataset(spark, d)
    train, test = _split(frame)
    forest = RandomForestRegressor(
        numTrees=20, maxDepth=6, seed=training.SEED, labelCol=Y, featuresCol="features", predictionCol="raw_prediction"
    )
    model = training.fit_prepared(train, columns, forest, CATEGORIES)
    return forecasting.interval_from_trees(model, test, columns, ["station", "time"])


@query("serving_frame", "K3 K9")
def _(spark, d):
    """Features of the next hour of every station in the model's column order, and the weather carried into it."""
    _, columns, history = dataset(spark, d)
    return forecasting.next_hour_features(history, columns, categories=CATEGORIES)


@query(
    "ar1_per_station", "J17 J11",
    s.cte("target", l=f"SELECT station, {Y} AS y, lag({Y}) OVER (PARTITION BY station ORDER BY time) AS x FROM target")
    + "SELECT station, count(*) AS n, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope FROM l WHERE x IS NOT NULL GROUP BY 1", "intercept slope",
)
def _(spark, d):
    _, models, _ = training.autoregression(target(spark, d), Y, 1)
    return models.select("station", "n", "intercept", F.col("coefficients")[0].alias("slope"))


@query("autoregression", "J17 J19 B26 J11")
def _(spark, d):
    """AR(4) per station with training outliers smoothed, differenced where the unit-root test asks for it, kept within
    [max(0, min - 2 sd), max + 3 sd] of the training values, and guarded."""
    series = cut_lineage(target(spark, d))
    split = lagging.split_per_key(series)
    train = split.where("is_train")
    cleaned = clean_training_series(train, train, Y)
    orders = season.differencing_order(season.unit_root(cleaned, Y)).select("station", "d")
    before = F.lag(Y).over(lagging.series())
    worked = F.when(F.col("d") == 1, F.col(Y) - before).otherwise(F.col(Y))
    _, models, names = training.autoregression(cleaned.join(orders, "station").select("station", "time", worked.alias("_z")), "_z", 4)
    framed = split.join(orders, "station").withColumns({"_z": worked, "_base": F.when(F.col("d") == 1, before).otherwise(0.0)})
    lagged = framed.withColumns(lagging.lags("_z", range(1, 5)))
    scored = training.apply_grouped(lagged.where("NOT is_train"), models, names, least=None).join(training_bounds(train, Y), "station")
    clipped = scored.withColumn("prediction", clip(F.col("prediction") + F.col("_base"), F.col("_low"), F.col("_high")))
    quality = evaluate.metrics(clipped, Y, "prediction", ["station"]).select("station", "n", "mae", "r2")
    return quality.join(training.guard(clipped, train, Y, ["station"]), "station")


@query("seasonal_regression", "J18 J11")
def _(spark, d):
    """Trend, daily and weekly terms and weather per station, scored on the held-out rows."""
    history = lagging.split_per_key(prepared(spark, d))
    framed, models, names = training.seasonal_regression(history.where("is_train"), Y, ["temperature", "humidity"])
    tested, _ = training.fourier_terms(history.where("NOT is_train"))
    scored = training.apply_grouped(tested, models, names)
    return evaluate.metrics(scored, Y, "prediction", ["station"])


_ANGLE = "epoch(time) % 86400 * (2 * pi() / 86400)"


def _det(a: str, b: str, c: str) -> str:
    """Determinant of the matrix of three rows of three."""
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = (x.split() for x in (a, b, c))
    return f"({a1} * ({b2} * {c3} - {b3} * {c2}) - {a2} * ({b1} * {c3} - {b3} * {c1}) + {a3} * ({b1} * {c2} - {b2} * {c1}))"


_NORMAL = {
    "f": f"SELECT station, time, {Y} AS y, epoch(time) / 86400e0 - 19000e0 AS x1, sin({_ANGLE}) AS x2, cos({_ANGLE}) AS x3 FROM target",
    "g": "SELECT station, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, "
         + ", ".join(f"regr_sxy(x{i}, x{j})" + (" + 1e-6" if i == j else "") + f" AS s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + ", "
         + ", ".join(f"regr_sxy(y, x{i}) AS t{i}" for i in (1, 2, 3)) + " FROM f WHERE y IS NOT NULL GROUP BY 1",
    "d": "SELECT *, " + _det("s11 s12 s13", "s21 s22 s23", "s31 s32 s33") + " AS det FROM g",
    "b": "SELECT *, " + _det("t1 s12 s13", "t2 s22 s23", "t3 s32 s33") + " / det AS b1, " + _det("s11 t1 s13", "s21 t2 s23", "s31 t3 s33") + " / det AS b2, "
         + _det("s11 s12 t1", "s21 s22 t2", "s31 s32 t3") + " / det AS b3 FROM d",
}


@query(
    "seasonal_regression_daily", "J18 J11",
    s.cte("target", **_NORMAL) + "SELECT f.station, time, n, greatest(0, my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3)) AS prediction FROM f JOIN b ON f.station = b.station", "prediction",
)
def _(spark, d):
    """Trend and one daily wave per station; SQL solves the same normal equations."""
    series = target(spark, d)
    framed, models, names = training.seasonal_regression(series, Y, daily=1, weekly=0)
    scored = training.apply_grouped(framed, models, names)
    return scored.join(models.select("station", "n"), "station").select("station", "time", "n", "prediction")


@query("station_models", "J11 L7")
def _(spark, d):
    """One boosted model that splits on the station, scored per station, without a job per station."""
    frame, columns, _ = dataset(spark, d)
    train, test = _split(frame)
    boosted = GBTRegressor(labelCol=Y, featuresCol="features", predictionCol="raw_prediction", maxIter=10, maxDepth=4, seed=training.SEED)
    model = training.fit_prepared(train, columns, boosted, CATEGORIES)
    return training.compare({"boosted": model}, test, columns, keys=["station"])


@query("prediction_guard", "J19",
       s.cte("target", l=f"SELECT station, time, {Y} AS y, lag({Y}) OVER (PARTITION BY station ORDER BY time) * 3 AS p FROM target",
             a="SELECT station, avg(p) AS mean_pred, stddev_pop(p) AS sd_pred, sqrt(avg((y - p) * (y - p))) AS rmse FROM l GROUP BY 1",
             b="SELECT station, avg(y) AS m, stddev_pop(y) AS sd FROM l GROUP BY 1")
       + "SELECT a.station, mean_pred, sd_pred, rmse, NOT (abs(mean_pred) > 5 * abs(m) OR sd_pred > 5 * sd OR rmse > 5 * sd) AS accepted FROM a JOIN b ON a.station = b.station",
       "mean_pred sd_pred rmse")
def _(spark, d):
    series = target(spark, d)
    tripled = series.withColumn("prediction", lagging.lags(Y, [1])[f"{Y}_lag_1h"] * 3)
    return training.guard(tripled, series, Y, ["station"])


def _clustered(spark, d):
    wx = feeds.hourly_weather_station(spark, d)
    return clusters.cluster(wx, ["temperature", "humidity", "wind_speed"], ["weather_icon"])


@query("kmeans_profile", "J14 J16 D24 D12")
def _(spark, d):
    rows, _ = _clustered(spark, d)
    return clusters.label_clusters(clusters.profile(rows, ["temperature", "humidity", "wind_speed"]))


@query("pca_2", "J15")
def _(spark, d):
    rows, _ = _clustered(spark, d)
    return rows.select("station", "time", "cluster", "pc1", "pc2")


_PAIR = (
    s.cte("wx", k="SELECT station, time, temperature AS x, wind_speed AS y FROM wx WHERE temperature IS NOT NULL AND wind_speed IS NOT NULL",
          c="SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b, count(*) AS n FROM k",
          e="SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM c",
          v="SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS w, l1 / (l1 + l2) AS share FROM e")
)


@query("pca_pair", "J15", _PAIR + "SELECT station, time, abs((x - mx) * u + (y - my) * w) AS pc1, abs((y - my) * u - (x - mx) * w) AS pc2, share FROM k, v", "pc1 pc2 share")
def _(spark, d):
    """Projection of two numbers without conditions, where SQL knows the axes; axes have no sign."""
    wx = feeds.hourly_weather_station(spark, d)
    rows, model = clusters.cluster(wx, ["temperature", "wind_speed"], [])
    share = float(model.stages[-1].explainedVariance[0])
    return rows.select("station", "time", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"), F.lit(share).alias("share"))


@query("clusters_of_many", "J14 J15 J16")
def _(spark, d):
    """Clusters over numbers and two categories, one of them with up to 1500 levels."""
    rows, _ = many_stations(spark, d)
    daily = rows.groupBy("station", F.dayofweek("time").cast("string").alias("weekday")).agg(F.avg("value").alias("temperature"), F.avg("hour").alias("wind_speed"))
    found, _ = clusters.cluster(daily, ["temperature", "wind_speed"], ["station", "weekday"])
    return clusters.label_clusters(clusters.profile(found, ["temperature", "wind_speed"]))


@query("saved_model", "J13")
def _(spark, d):
    """A model saved, loaded again and applied; both predictions side by side."""
    import uuid

    from airgrid.session import shared_dir

    frame, columns, _ = dataset(spark, d)
    train, test = _split(frame)
    model = training.fit_models(train, columns, ["linear"], with_ridge=False, categories=CATEGORIES)["linear"]
    place = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    training.save_model(model, place)
    before = training.predict(model, test, columns, ["station", "time"])
    after = training.predict(training.load_model(place), test, columns, ["station", "time"]).withColumnRenamed("prediction", "reloaded")
    return before.join(after, ["station", "time"])


_LAGGED = (
    f"SELECT station, time, {Y} AS y, lag({Y}) OVER (PARTITION BY station ORDER BY time) AS x, row_number() OVER (PARTITION BY station ORDER BY time) AS rn, "
    "count(*) OVER (PARTITION BY station) - 24 AS n FROM target"
)
_TRAIN = "SELECT * FROM lagged WHERE rn > 24 AND rn - 24 <= floor(n * 0.8e0)"
_TEST = "SELECT * FROM lagged WHERE rn > 24 AND rn - 24 > floor(n * 0.8e0)"


def _one_feature(spark, d):
    """Training and test rows with the previous hour as the only feature."""
    frame = lagging.split_per_key(plan.pooled(target(spark, d)))
    return _split(cut_lineage(frame.select("station", "time", Y, f"{Y}_lag_1h", "is_train")))


@query(
    "linear_model", "J2 J3 J8",
    s.cte("target", lagged=_LAGGED, train=_TRAIN, test=_TEST, m="SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train")
    + "SELECT station, time, greatest(0, a + b * x) AS prediction FROM test, m", "prediction",
)
def _(spark, d):
    train, test = _one_feature(spark, d)
    columns = [f"{Y}_lag_1h"]
    model = training.fit_models(train, columns, ["linear"], with_ridge=False)["linear"]
    return training.predict(model, test, columns, ["station", "time"])


@query(
    "ridge_model", "J2 J4",
    s.cte("target", lagged=_LAGGED, train=_TRAIN, test=_TEST,
          m="SELECT avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, regr_sxy(y, x) / stddev_samp(x) / (regr_sxx(y, x) / (stddev_samp(x) * stddev_samp(x)) + 0.5e0) AS b FROM train WHERE x IS NOT NULL")
    + "SELECT station, time, greatest(0, my + b * (x - mx) / sx) AS prediction FROM test, m", "prediction",
)
def _(spark, d):
    train, test = _one_feature(spark, d)
    columns = [f"{Y}_lag_1h"]
    model = training.fit_models(train, columns, [], with_ridge=True)["ridge"]
    return training.predict(model, test, columns, ["station", "time"])


@query(
    "train_mean_impute", "H11 J2",
    s.cte("model_gaps", r="SELECT *, row_number() OVER (PARTITION BY station ORDER BY time) <= floor(count(*) OVER (PARTITION BY station) * 0.8e0) AS is_train FROM model_gaps",
          m="SELECT avg(wind_speed) AS mean FROM r WHERE is_train", f="SELECT station, time, is_train, coalesce(wind_speed, mean) AS w FROM r, m",
          sc="SELECT avg(w) AS mu, stddev_samp(w) AS sd FROM f WHERE is_train")
    + "SELECT station, time, w AS wind_speed, (w - mu) / sd AS scaled FROM f, sc WHERE NOT is_train", "wind_speed scaled",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = lagging.split_per_key(cut_lineage(model_gaps(spark, d).select("station", "time", "wind_speed")))
    train, test = _split(rows)
    fitted = Pipeline(stages=training.preparation(["wind_speed"])).fit(train).transform(test)
    return fitted.select("station", "time", F.col("_f_wind_speed").alias("wind_speed"), vector_to_array("features")[0].alias("scaled"))


@query(
    "cluster_profile", "D24",
    s.cte("wx") + "SELECT weather_icon AS cluster, count(*) AS n, avg(humidity) AS humidity, avg(wind_speed) AS wind_speed FROM wx GROUP BY 1", "humidity wind_speed",
)
def _(spark, d):
    """Profile of given groups (here the icon), without the arbitrary ids of a clustering."""
    wx = feeds.hourly_weather_station(spark, d).withColumnRenamed("weather_icon", "cluster")
    return clusters.profile(wx, ["humidity", "wind_speed"])


_SERVED = {f"{Y}_lag_1h": "y1", f"{Y}_lag_24h": "y24", f"{Y}_diff_24h": "y1 - y25", f"{Y}_rolling_mean_6h": "m6", f"{Y}_rolling_std_24h": "s24", f"{Y}_rolling_max_12h": "x12"}


@query(
    "serving_features", "K3 G8",
    s.cte("target", r=f"SELECT station, time, {Y} AS y, row_number() OVER (PARTITION BY station ORDER BY time DESC) AS k FROM target",
          a="SELECT station, max(time) + INTERVAL 1 HOUR AS time, max(CASE WHEN k = 1 THEN y END) AS y1, max(CASE WHEN k = 24 THEN y END) AS y24, max(CASE WHEN k = 25 THEN y END) AS y25, "
            "avg(CASE WHEN k <= 6 THEN y END) AS m6, stddev_samp(CASE WHEN k <= 24 THEN y END) AS s24, max(CASE WHEN k <= 12 THEN y END) AS x12 FROM r GROUP BY 1")
    + "SELECT station, time, " + ", ".join(f"{v} AS {k}" for k, v in _SERVED.items()) + ", CAST(hour(time) AS DOUBLE) AS hour FROM a", " ".join(_SERVED),
)
def _(spark, d):
    return forecasting.next_hour_features(target(spark, d), [*_SERVED, "hour"])


@query(
    "recursive_linear", "K1 K2",
    s.cte("target", lagged=_LAGGED, m="SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM lagged WHERE rn > 24").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", steps AS (SELECT station, max(time) AS time, 0 AS horizon, arg_max({Y}, time) AS forecast FROM target GROUP BY 1 UNION ALL "
    "SELECT station, time + INTERVAL 1 HOUR, horizon + 1, greatest(0, a + b * forecast) FROM steps, m WHERE horizon < 24) "
    "SELECT station, time, horizon, forecast FROM steps WHERE horizon > 0", "forecast",
)
def _(spark, d):
    """24 recursive hours of a model that sees the previous hour only; SQL can repeat that recursion."""
    history = cut_lineage(target(spark, d))
    columns = [f"{Y}_lag_1h"]
    model = training.fit_models(plan.pooled(history), columns, ["linear"], with_ridge=False)["linear"]
    return forecasting.recursive_forecast(model, history, columns, 24)


_STEPS = 48
_PROFILES = ["hour_avg", "dow_avg"]


def _sum_of(part: str) -> str:
    """Sum and number of the forecasts so far that fall on the hour or weekday of the next one."""
    same = f"[made[i] FOR i IN range(1, len(made) + 1) IF {part}(last + i * INTERVAL 1 HOUR) = {part}(last + (horizon + 1) * INTERVAL 1 HOUR)]"
    return f"coalesce(list_sum({same}), 0)", f"len({same})"


@query(
    "recursive_profiles", "K2 K1 E6",
    s.cte(
        "target",
        p=f"SELECT station, time, {Y} AS y, avg({Y}) OVER (PARTITION BY station, hour(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x1, "
          f"avg({Y}) OVER (PARTITION BY station, dayofweek(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x2 FROM target",
        k="SELECT * FROM p WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL",
        c="SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1, regr_sxy(y, x2) AS s2 FROM k",
        b="SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM c",
        m="SELECT b1, b2, my - b1 * m1 - b2 * m2 AS a FROM b",
        h=f"SELECT station, hour(time) AS hour, sum({Y}) AS hs, count({Y}) AS hn FROM target GROUP BY 1, 2",
        w=f"SELECT station, dayofweek(time) AS dow, sum({Y}) AS ws, count({Y}) AS wn FROM target GROUP BY 1, 2",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + ", steps AS (SELECT station, max(time) AS last, 0 AS horizon, CAST([] AS DOUBLE[]) AS made FROM target GROUP BY 1 UNION ALL "
    "SELECT s.station, last, horizon + 1, list_append(made, greatest(0, a + "
    f"b1 * (hs + {_sum_of('hour')[0]}) / (hn + {_sum_of('hour')[1]}) + b2 * (ws + {_sum_of('dayofweek')[0]}) / (wn + {_sum_of('dayofweek')[1]}))) "
    "FROM steps s JOIN h ON h.station = s.station AND h.hour = hour(last + (horizon + 1) * INTERVAL 1 HOUR) "
    f"JOIN w ON w.station = s.station AND w.dow = dayofweek(last + (horizon + 1) * INTERVAL 1 HOUR), m WHERE horizon < {_STEPS}) "
    f"SELECT station, last + i * INTERVAL 1 HOUR AS time, CAST(i AS INTEGER) AS horizon, made[i] AS forecast FROM steps, range(1, {_STEPS} + 1) r(i) WHERE horizon = {_STEPS}",
    "forecast",
)
def _(spark, d):
    """48 recursive hours of a model that sees the means of the hour and the weekday, which take up every forecast made."""
    history = cut_lineage(target(spark, d))
    columns = [f"{Y}_{p}" for p in _PROFILES]
    train = history.withColumns(lagging.running_profiles(Y)).na.drop("any", subset=[Y, *columns])
    model = training.fit_models(train, columns, ["linear"], with_ridge=False)["linear"]
    return forecasting.recursive_forecast(model, history, columns, _STEPS)


@query("recursive_week", "K2 K9")
def _(spark, d):
    """168 recursive hours over lags, profiles, persisted weather and the persisted ratio of two pollutants."""
    history = cut_lineage(plan.prepare(model_gaps(spark, d), [Y, *WEATHER_NUMERIC]).join(feeds.hourly_wide(spark, d).select("station", "time", "pm25", "pm10"), ["station", "time"], "left"))
    ratio = {forecasting.RATIO: F.col("pm25") / (F.col("pm10") + 0.001)}
    frame = cut_lineage(plan.pooled(history).withColumns(lagging.running_profiles(Y) | ratio))
    columns = plan.feature_columns(frame)
    model = training.fit_models(frame, columns, ["linear"], with_ridge=False, categories=["station"])["linear"]
    return forecasting.recursive_forecast(model, history, columns, 168, categories=["station"])


MANY_STATIONS = 1500
# A station per user modulo so many; value by a feature that differs between the rows of a station.
_MANY = f"SELECT 'U' || (user_id % {MANY_STATIONS}) AS station, ts AS time, value, CAST(hour(ts) AS DOUBLE) AS hour, CAST(dayofyear(ts) AS DOUBLE) AS day FROM events"
_MANY_TRAIN = "SELECT * FROM many WHERE value IS NOT NULL AND dayofmonth(time) <= 20"


def many_stations(spark, d):
    """Readings of up to 1500 stations with two calendar features; the first 20 days of a month are for training."""
    e = feeds.events(spark, d)
    rows = e.select(
        F.concat(F.lit("U"), (F.col("user_id") % MANY_STATIONS).cast("string")).alias("station"), F.col("ts").alias("time"), "value",
        F.hour("ts").cast("double").alias("hour"), F.dayofyear("ts").cast("double").alias("day"),
    )
    return rows, rows.where((F.dayofmonth("time") <= 20) & F.col("value").isNotNull())


def kept_models(spark, models):
    """The models as they come back from their table, stored twice and beside others of the same stations."""
    import uuid

    from airgrid.session import shared_dir

    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    station_models.store(models.withColumns({"kind": F.lit("older"), "intercept": F.lit(0.0)}), path)
    station_models.store(models.withColumn("intercept", F.lit(-1.0)), path)
    station_models.store(models, path)
    return station_models.load(spark, path)


@query(
    "stored_station_models", "J11 J3 J13",
    "WITH many AS (" + _MANY + "), train AS (" + _MANY_TRAIN + "), m AS (SELECT station, count(*) AS n, regr_slope(value, hour) AS b, regr_intercept(value, hour) AS a, avg(value) AS mean FROM train GROUP BY 1) "
    "SELECT many.station, time, many.value, n, greatest(0, coalesce(a + b * hour, mean)) AS prediction FROM many JOIN m ON m.station = many.station WHERE dayofmonth(time) > 20", "value prediction",
)
def _(spark, d):
    """A linear model for each of up to 1500 stations, fitted in one job, stored by station, reloaded and applied."""
    rows, train = many_stations(spark, d)
    models = kept_models(spark, station_models.fit_linear(train, ["hour"], "value"))
    scored = station_models.score(rows.where(F.dayofmonth("time") > 20), models, ["hour"], "linear")
    counts = models.where("kind = 'linear'").select("station", "n")
    return scored.join(counts, "station").select("station", "time", "value", "n", "prediction")


def _round_sql(k: int, rate: float) -> dict[str, str]:
    """One round of boosting on ``e{k}`` (row, station, hour, day, residual): the best split of each station, and the next residuals."""
    sides = []
    for i, f in enumerate(("hour", "day")):
        sides.append(
            f"SELECT station, {i} AS feature, {f} AS threshold, sum(sum(res)) OVER w AS ls, sum(count(*)) OVER w AS ln, lead({f}) OVER w AS following, "
            f"sum(sum(res)) OVER (PARTITION BY station) AS ts, sum(count(*)) OVER (PARTITION BY station) AS tn FROM e{k} GROUP BY station, {f} WINDOW w AS (PARTITION BY station ORDER BY {f})"
        )
    return {
        f"s{k}": " UNION ALL ".join(f"SELECT * FROM ({x})" for x in sides),
        f"g{k}": f"SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM s{k} WHERE following IS NOT NULL",
        f"b{k}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(gain, 7) DESC, feature, threshold) AS rn FROM g{k} WHERE gain > 1e-12) WHERE rn = 1",
        f"e{k + 1}": f"SELECT e.station, e.time, e.value, e.hour, e.day, e.is_train, e.made + d AS made, e.res - d AS res FROM (SELECT a.*, coalesce(CASE WHEN CASE feature WHEN 0 THEN a.hour ELSE a.day END <= threshold "
                     f"THEN {rate}e0 * ls / ln ELSE {rate}e0 * (ts - ls) / (tn - ln) END, 0) AS d FROM x{k} a LEFT JOIN b{k} b ON a.station = b.station) e",
    }


def _boosted_sql(rounds: int, rate: float) -> str:
    parts = {"many": _MANY, "train": _MANY_TRAIN, "start": "SELECT station, avg(value) AS mean, count(*) AS n FROM train GROUP BY 1",
             "x0": "SELECT m.*, dayofmonth(time) <= 20 AND value IS NOT NULL AS is_train, mean AS made, value - mean AS res FROM many m JOIN start s ON m.station = s.station", "e0": "SELECT * FROM x0 WHERE is_train"}
    for k in range(rounds):
        made = _round_sql(k, rate)
        parts |= {c: t for c, t in made.items() if c != f"e{k + 1}"}
        parts |= {f"x{k + 1}": made[f"e{k + 1}"], f"e{k + 1}": f"SELECT * FROM x{k + 1} WHERE is_train"}
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in parts.items()) + f" SELECT station, time, value, greatest(0, made) AS prediction FROM x{rounds} WHERE NOT is_train AND dayofmonth(time) > 20"


_ROUNDS, _RATE = 3, 0.5


@query("boosted_station_models", "J6 J7 J11 J13", _boosted_sql(_ROUNDS, _RATE), "value prediction")
def _(spark, d):
    """Boosted stumps for each of up to 1500 stations in one job, stored as rows, reloaded and applied; SQL repeats every round."""
    rows, train = many_stations(spark, d)
    models = kept_models(spark, station_models.fit_boosted(train, ["hour", "day"], "value", _ROUNDS, _RATE))
    scored = station_models.score(rows.where(F.dayofmonth("time") > 20), models, ["hour", "day"], "boosted")
    return scored.where("prediction IS NOT NULL").select("station", "time", "value", "prediction")


_HELD_OUT = (
    s.cte("model_gaps", r="SELECT row_number() OVER (PARTITION BY station ORDER BY time) - 24 AS rn, count(*) OVER (PARTITION BY station) - 24 AS n FROM model_gaps",
          held="SELECT * FROM r WHERE rn > 0 AND rn > floor(n * 0.8e0)")
)


@query("saved_model_equal", "J13", _HELD_OUT + "SELECT count(*) AS n, count(*) AS n_equal FROM held")
def _(spark, d):
    """A loaded model predicts what the saved one did, for every held-out row."""
    same = F.abs(F.col("prediction") - F.col("reloaded")) <= 1e-9
    return REGISTRY["saved_model"].run(spark, d).agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"))


@query("tree_intervals_ordered", "K8", _HELD_OUT + "SELECT count(*) AS n, count(*) AS n_ordered FROM held")
def _(spark, d):
    """Lower bound, mean of the trees' range and upper bound are in order and not negative, for every held-out row."""
    ordered = (F.col("lower_bound") >= 0) & (F.col("lower_bound") <= F.col("upper_bound"))
    return REGISTRY["tree_intervals"].run(spark, d).agg(F.count("*").alias("n"), F.count_if(ordered).alias("n_ordered"))
