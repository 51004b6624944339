"""Models: closed forms, determinism, forecasts that beat the naive one."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from airgrid.operators import evaluate, lagging, reshape
from airgrid.plans import features, forecasting, training
from airgrid.session import shared_dir


def seasonal(n, phase=0.0, seed=1, noise=1.0):
    rng = random.Random(seed)
    return [60 + 25 * math.sin(2 * math.pi * (i % 24) / 24 + phase) + rng.gauss(0, noise) for i in range(n)]


@pytest.fixture
def history(series):
    return series({"A": seasonal(24 * 20), "B": seasonal(24 * 20, 2.0, 2)}, columns="overall_aqi DOUBLE").withColumn("temperature", F.lit(20.0) + F.hour("time"))


def test_default_features_hold_nothing_of_the_current_hour(spark, history):
    """Changing the newest target must not change any feature of its own row."""
    last = history.agg(F.max("time")).first()[0]
    changed = history.withColumn("overall_aqi", F.when(F.col("time") == F.lit(last), 9999.0).otherwise(F.col("overall_aqi")))
    a, b = (features.pooled(h).where(F.col("time") == F.lit(last)).orderBy("station") for h in (history, changed))
    columns = features.feature_columns(a)
    assert a.select(columns).collect() == b.select(columns).collect()
    leaky = features.pooled(changed, leakage_safe=False).where(F.col("time") == F.lit(last)).orderBy("station")
    assert leaky.select("overall_aqi_diff_2h").collect() != a.select("overall_aqi_diff_2h").collect()


def test_serving_features_equal_training_features(spark, history):
    """The features served for hour t equal the ones built when hour t is part of the history."""
    last = history.agg(F.max("time")).first()[0]
    built = features.pooled(history).where(F.col("time") == F.lit(last))
    columns = [c for c in features.feature_columns(built) if c.startswith("overall_aqi") or "hour" in c or c in ("day_of_week", "month", "is_daytime")]
    served = forecasting.next_hour_features(history.where(F.col("time") < F.lit(last)), columns)
    for want, got in zip(built.orderBy("station").collect(), served.orderBy("station").collect()):
        assert got.time == want.time
        for c in columns:
            assert got[c] == pytest.approx(want[c], abs=1e-6), c


def test_recursive_forecast_beats_the_naive_one(spark, history):
    past, truth = forecasting.holdout(history, 24)
    stations = reshape.levels(past, "station")
    frame = features.add_dummies(features.pooled(past), stations)
    columns = features.feature_columns(frame)
    model = training.fit_models(frame, columns, ["linear"], with_ridge=False)["linear"]
    made = forecasting.recursive_forecast(model, past, columns, 24, stations)
    again = forecasting.recursive_forecast(model, past, columns, 24, stations, cut_every=24)
    rows = {(r.station, r.horizon): r.forecast for r in made.collect()}
    assert len(rows) == 48
    for r in again.collect():
        assert rows[r.station, r.horizon] == pytest.approx(r.forecast, abs=1e-9)

    def mae(df):
        j = truth.join(df, ["station", "time"]).select(F.col("overall_aqi").alias("y"), F.col("forecast").alias("p"))
        return evaluate.metrics(j).first().mae

    assert mae(made) < mae(forecasting.seasonal_naive(past)) + 0.2 and mae(made) < 2.0
    assert mae(forecasting.pattern_forecast(past)) < 2.0


def test_external_weather_replaces_the_last_value(spark, history):
    ahead = forecasting.future_weather(history, 2, None, ["temperature"])
    given = ahead.where("horizon = 1").select("station", "time", F.lit(-5.0).alias("temperature"))
    got = {(r.station, r.horizon): r.temperature for r in forecasting.future_weather(history, 2, given, ["temperature"]).collect()}
    assert got["A", 1] == -5.0 and got["A", 2] == 43.0


def test_grouped_least_squares_equals_mllib(spark, series):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=300), rng.normal(size=300)
    rows = [("A" if i < 200 else "B", float(x[i]), float(z[i]), float(3 + 2 * x[i] - z[i] * (1 if i < 200 else 4) + rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "station STRING, x DOUBLE, z DOUBLE, y DOUBLE")
    got = {r.station: r for r in training.grouped_least_squares(df, ["x", "z"], "y").collect()}
    from pyspark.ml.feature import VectorAssembler

    for s in "AB":
        part = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(df.where(F.col("station") == s))
        m = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(part)
        assert got[s].intercept == pytest.approx(m.intercept) and got[s].coefficients == pytest.approx(m.coefficients.toArray().tolist())
    scored = training.apply_grouped(df, spark.createDataFrame(list(got.values())), ["x", "z"])
    assert evaluate.metrics(scored, "y", "prediction").first().mae < 3


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(80, 3))
    y = X @ [1.0, -2.0, 0.5] + rng.normal(size=80)
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(X, y)], "a DOUBLE, b DOUBLE, c DOUBLE, overall_aqi DOUBLE")
    df = df.select("overall_aqi", array_to_vector(F.array("a", "b", "c")).alias("features"))
    got = training.ridge(df, 0.5).fit(df).coefficients.toArray()
    Xc, yc = X - X.mean(0), y - y.mean()
    assert got == pytest.approx(np.linalg.solve(Xc.T @ Xc + 0.5 * np.eye(3), Xc.T @ yc), abs=1e-6)


def test_autoregression_finds_its_coefficients(spark, series):
    rng = np.random.default_rng(4)
    x = [0.0, 0.0]
    for e in rng.normal(size=3000).tolist():
        x.append(0.5 * x[-1] + 0.2 * x[-2] + e)
    _, models, _ = training.autoregression(series({"A": x}), "v", 2)
    assert models.first().coefficients == pytest.approx([0.5, 0.2], abs=0.06)


def test_models_are_deterministic_and_can_be_saved(spark, history):
    frame = lagging.split_per_key(features.pooled(history))
    columns = ["overall_aqi_lag_1h", "overall_aqi_lag_24h", "hour"]
    first, second = (training.fit_models(frame, columns, ["random_forest"], with_ridge=True) for _ in range(2))
    a, b = (training.compare(m, frame, columns).orderBy("model").collect() for m in (first, second))
    assert a == b
    place = f"{shared_dir(spark)}/m-{random.random()}"
    training.save_model(first["random_forest"], place)
    again = training.compare({"random_forest": training.load_model(place)}, frame, columns).first()
    assert again.mae == pytest.approx(next(r.mae for r in a if r.model == "random_forest"))
    tops = training.importances(first["random_forest"], columns, spark, 2).collect()
    assert len(tops) == 2 and tops[0].importance >= tops[1].importance
    bounds = forecasting.interval_from_trees(first["random_forest"], frame, columns, ["station", "time"]).where("lower_bound > forecast OR upper_bound < forecast")
    assert bounds.count() == 0


def test_grid_search_orders_by_error(spark, history):
    frame = features.pooled(history)

    def make(regParam):
        return LinearRegression(labelCol="overall_aqi", featuresCol="features", predictionCol="raw_prediction", regParam=regParam)

    results = training.grid_search(frame, ["overall_aqi_lag_1h", "hour_sin", "hour_cos"], make, {"regParam": [100.0, 0.01]}, folds=3)
    assert [r["params"]["regParam"] for r in results] == [0.01, 100.0]


def test_training_rows_are_packed_whatever_the_shuffle_setting(spark, history):
    frame = features.pooled(history)
    columns = ["overall_aqi_lag_1h", "hour_sin"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    made = []

    def make(regParam):
        class Seen(LinearRegression):
            def _fit(self, rows):
                made.append((rows.rdd.getNumPartitions(), rows.count()))
                return super()._fit(rows)

        return Seen(labelCol="overall_aqi", featuresCol="features", predictionCol="raw_prediction", regParam=regParam)

    try:
        training.grid_search(frame, columns, make, {"regParam": [1.0]}, folds=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    n = frame.count()
    assert sorted(made) == [(1, n - 2 * (n // 3)), (1, n - n // 3)]
    packed = training.packed(frame, training.ROWS_PER_TASK + 1)
    assert packed.rdd.getNumPartitions() == 2 and packed.exceptAll(frame).count() == 0 and frame.exceptAll(packed).count() == 0


def test_single_fits_are_packed_too(spark, history):
    frame = features.pooled(history).repartition(30, "time")
    seen = []

    class Seen(LinearRegression):
        def _fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return super()._fit(rows)

    training.fit_prepared(frame, ["hour_sin"], Seen(labelCol="overall_aqi", featuresCol="features", predictionCol="raw_prediction"))
    assert seen == [(1, frame.count())]


def test_fits_read_cached_vectors(spark, history, monkeypatch):
    """A tree fit reads its rows several times; they are prepared once, and nothing stays cached."""
    frame = features.pooled(history)
    seen = []

    class Seen(GBTRegressor):
        def _fit(self, rows):
            seen.append((rows.storageLevel.useMemory, sorted(rows.columns)))
            return super()._fit(rows)

    boosted = Seen(labelCol="overall_aqi", featuresCol="features", predictionCol="raw_prediction", maxIter=1, maxDepth=2)
    monkeypatch.setattr(training, "boosted", lambda *rounds, **params: boosted)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    training.tune_boosted(frame, ["hour_sin"], {"maxDepth": [2]}, (1,), folds=2)
    training.grid_search(frame, ["hour_sin"], lambda maxDepth: boosted, {"maxDepth": [2]}, folds=2)
    training.fit_prepared(frame, ["hour_sin"], boosted)
    assert seen == [(True, ["features", "overall_aqi"])] * 5
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= held


def test_boosted_models_are_tuned_over_the_whole_grid(spark, history, monkeypatch):
    """Every step and depth, 50, 100 and 200 rounds, five folds; the best may use as many rounds as it was ranked with, and the
    other model has the usual 100."""
    from airgrid.queries import modelling

    frame = lagging.split_per_key(features.pooled(history))
    asked = []

    def ranked(splits, make, combos, label, parallelism):
        asked.append((len(splits), {(m.getMaxIter(), m.getMaxDepth(), m.getStepSize()) for m in (make(**c) for c in combos)}))
        return [{"params": c, "rmse": float(i)} for i, c in enumerate(combos)]

    class Short(GBTRegressor):
        def _fit(self, rows):
            asked.append((self.getMaxIter(), self.getMaxDepth(), self.getStepSize()))
            return GBTRegressor._fit(self.copy({self.maxIter: 1}), rows)

    monkeypatch.setattr(training, "GBTRegressor", Short)
    monkeypatch.setattr(training, "ranked_over_folds", ranked)
    monkeypatch.setattr(modelling, "dataset", lambda spark, d: (frame, ["hour_sin"], history))
    monkeypatch.setattr(modelling, "CATEGORIES", ["station"])
    rows = modelling.REGISTRY["tuned_boosting"].run(spark, "").collect()
    (folds, first), (_, second), (_, third), tuned, base = asked
    assert folds == 5 and first == {(50, d, s) for d in (3, 5, 7) for s in (0.01, 0.05, 0.1)}
    assert ({r for r, _, _ in second}, len(second)) == ({100}, 4) and ({r for r, _, _ in third}, len(third)) == ({200}, 2)
    assert tuned == (200, 3, 0.01) and base == (100, 5, 0.1)
    assert [r["name"] for r in rows] == ["stage 2"] * 2 + ["stage 1"] * 4 + ["stage 0"] * 9 + ["tuned", "base"]


def test_small_steps_are_not_stopped_at_their_start(spark, series):
    noisy = series({"A": seasonal(24 * 40, noise=25.0)}, columns="overall_aqi DOUBLE").withColumn("hour", F.hour("time"))
    model, used = training.fit_boosted(noisy, ["hour"], {"maxDepth": 1, "stepSize": 0.01}, 12)
    assert used == len(model.stages[-1].trees) == 12


def test_seasonal_regression_and_guard(spark, history):
    split = lagging.split_per_key(history)
    framed, models, names = training.seasonal_regression(split.where("is_train"), "overall_aqi")
    tested, _ = training.fourier_terms(split.where("NOT is_train"))
    scored = training.apply_grouped(tested, models, names)
    assert evaluate.metrics(scored, "overall_aqi", "prediction").first().mae < 2
    assert all(r.accepted for r in training.guard(scored, split.where("is_train"), "overall_aqi", ["station"]).collect())
    wild = scored.withColumn("prediction", F.col("prediction") * 10)
    assert not any(r.accepted for r in training.guard(wild, split.where("is_train"), "overall_aqi", ["station"]).collect())


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 12.0), (60.0, 50.0), (0.0, 1.0), (None, 5.0)], "y DOUBLE, p DOUBLE")
    m = evaluate.metrics(df).first()
    assert (m.n, m.mae) == (3, pytest.approx(13 / 3)) and m.rmse == pytest.approx(math.sqrt(105 / 3))
    assert m.mape == pytest.approx((0.2 + 1 / 6) / 2 * 100) and m.category_accuracy == pytest.approx(200 / 3)


def test_clusters_are_named_by_their_centres(spark, series):
    from airgrid.plans import clusters

    rng = np.random.default_rng(0)
    rows = []
    for i, (t, h, w) in enumerate([(35, 30, 5), (15, 90, 5), (22, 60, 40)]):
        rows += [("S", f"t{i}{j}", float(t + rng.normal()), float(h + rng.normal()), float(w + rng.normal()), "rain") for j in range(40)]
    df = spark.createDataFrame(rows, "station STRING, time STRING, temperature DOUBLE, humidity DOUBLE, wind_speed DOUBLE, weather_icon STRING")
    out, _ = clusters.cluster(df, ["temperature", "humidity", "wind_speed"], ["weather_icon"])
    named = {r.cluster_label: r for r in clusters.label_clusters(clusters.profile(out, ["temperature", "humidity", "wind_speed"])).collect()}
    assert named["hot-dry"].temperature > 30 and named["windy"].wind_speed > 35 and named["cool-humid"].humidity > 80
    assert abs(out.agg(F.avg("pc1")).first()[0]) < 1e-9


def test_clusters_over_many_levels(spark):
    from airgrid.plans import clusters

    df = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 1500).cast("string")).alias("sky"), (F.col("id") % 3 * 40 + F.rand(1)).alias("t"), F.when(F.col("id") > 5, F.rand(2)).alias("w"))
    out, model = clusters.cluster(df, ["t", "w"], ["sky"])
    assert out.count() == 2994 and out.columns == ["sky", "t", "w", "cluster", "pc1", "pc2"]
    assert out.groupBy("cluster").agg(F.max("t") - F.min("t")).where("`(max(t) - min(t))` > 1").count() == 0
    r = out.agg(F.avg("pc1"), F.avg("pc2"), F.var_samp("pc1"), F.corr("pc1", "t")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9 and abs(r[3]) > 0.999


def test_station_models_as_rows(spark):
    from airgrid.plans import station_models

    rng = np.random.default_rng(1)
    rows = [(f"S{i % 40}", float(x), float(i % 7), float(3 * x + i % 40) if i % 9 else None) for i, x in enumerate(rng.random(800))] + [("alone", 1.0, 2.0, 5.0), (None, 1.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "station STRING, x DOUBLE, z DOUBLE, y DOUBLE")
    path = f"{shared_dir(spark)}/models-{rng.integers(1 << 40)}"
    station_models.store(station_models.fit_linear(df, ["x"], "y"), path)
    station_models.store(station_models.fit_boosted(df.where("station IS NOT NULL"), ["x", "z"], "y", 30, 0.5), path)
    station_models.store(station_models.fit_linear(df.where("station = 'S1'"), ["x"], "y"), path)
    models = station_models.load(spark, path)
    assert models.groupBy("kind").count().collect() and models.count() == 41 + 1 + 41
    scored = station_models.score(df.where("y IS NOT NULL AND station LIKE 'S%'"), models, ["x"], "linear")
    assert scored.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-6
    boosted = station_models.score(df.where("y IS NOT NULL AND station LIKE 'S%'"), station_models.load(spark, path, ["S1", "S2"]), ["x", "z"], "boosted")
    r = boosted.agg(F.count("prediction"), F.avg(F.abs(F.col("prediction") - F.col("y"))), F.count_if(F.col("prediction").isNull())).first()
    assert 30 <= r[0] <= 40 and r[1] < 0.2 and r[2] > 600
    assert station_models.score(df, models, ["z"], "boosted").where("prediction IS NOT NULL").count() == 0  # other features, no model


def test_running_profiles_in_steps_and_folded(spark, history):
    """A tree that only hands on the profile follows the same accumulators as the folded linear model."""
    columns = ["overall_aqi_hour_avg", "overall_aqi_dow_avg"]
    train = history.withColumns(lagging.running_profiles("overall_aqi")).na.drop("any")
    model = training.fit_models(train, columns, ["linear"], with_ridge=False)["linear"]
    start = forecasting.station_state(history, 50, [], None, "overall_aqi", 1, True)
    folded = {(r.station, r.horizon): r.forecast for r in forecasting.recursive_forecast(model, history, columns, 50).collect()}
    stepped = forecasting._stepwise(model, start, columns, 50, (), [], "overall_aqi", 1, 10, ())
    for r in stepped.collect():
        assert [folded[r.station, i + 1] for i in range(50)] == pytest.approx(r._made)


def test_per_station_models(spark, history):
    frame = features.pooled(history)
    models = training.fit_per_station(
        frame, ["A", "B"], ["overall_aqi_lag_24h"], lambda: LinearRegression(labelCol="overall_aqi", featuresCol="features", predictionCol="raw_prediction")
    )
    assert set(models) == {"A", "B"} and isinstance(Pipeline(stages=[]), Pipeline)


def test_encoded_stations_equal_dummy_columns(spark, history):
    """One-hot vectors give the pooled model the same predictions as explicit 0/1 columns."""
    past = features.pooled(history)
    dummies = features.add_dummies(past, ["A", "B"])
    numeric = ["overall_aqi_lag_1h", "overall_aqi_lag_24h"]
    wide = training.fit_models(dummies, [*numeric, "station_B"], ["linear"], with_ridge=False)["linear"]
    sparse = training.fit_models(past, numeric, ["linear"], with_ridge=False, categories=["station"])["linear"]
    a = training.predict(wide, dummies, [*numeric, "station_B"], ["station", "time"]).orderBy("station", "time").collect()
    b = training.predict(sparse, past, numeric, ["station", "time"]).orderBy("station", "time").collect()
    assert [r.prediction for r in a] == pytest.approx([r.prediction for r in b], abs=1e-6)
    made = forecasting.recursive_forecast(sparse, history, numeric, 3)
    assert made.count() == 6 and made.where("forecast IS NULL").count() == 0


def test_many_stations_need_no_column_each(spark, series):
    history = series({f"S{i}": [float(i % 50 + h % 24) for h in range(30)] for i in range(1500)}, columns="overall_aqi DOUBLE")
    frame = features.pooled(history)
    columns = features.feature_columns(frame)
    model = training.fit_models(frame, columns, ["linear"], with_ridge=False, categories=["station"])["linear"]
    made = forecasting.recursive_forecast(model, history, columns, 2, categories=["station"])
    assert made.count() == 3000 and made.where("forecast IS NULL").count() == 0
    named = training.importances(model, columns, spark)
    assert named.count() == len(columns) + 1500


def test_unknown_columns_are_refused(spark, history):
    for column in ("overall_aqi_hour_avg", "made_up"):
        with pytest.raises(ValueError, match=column):
            forecasting.next_hour_features(history, ["overall_aqi_lag_1h", column])


def test_folded_steps_equal_single_steps_with_weather_and_long_lags(spark, history):
    icons = F.element_at(F.array(*[F.lit(x) for x in ("01d", "04d", "10n")]), F.hour("time") % 3 + 1)
    past = history.withColumn("weather_icon", icons)
    frame = features.pooled(past).withColumns(lagging.lags("overall_aqi", [48]) | {"weather": F.substring("weather_icon", 1, 2)}).na.drop()
    columns = [*features.feature_columns(frame)]
    assert "overall_aqi_lag_48h" in columns
    model = training.fit_models(frame, columns, ["linear"], with_ridge=False, categories=["station", "weather"])["linear"]
    folded = forecasting.recursive_forecast(model, past, columns, 48, categories=["station", "weather"])
    first = forecasting.next_hour_features(past, columns, categories=["weather"])
    raw = {r.station: r.raw_prediction for r in model.transform(first).collect()}
    got = {(r.station, r.horizon): r.forecast for r in folded.collect()}
    assert len(got) == 96
    for station, value in raw.items():
        assert got[station, 1] == pytest.approx(max(value, 0.0), abs=1e-6)
    start = forecasting.station_state(past, 48, ["temperature", "weather_icon"], None, "overall_aqi", forecasting.rows_needed(columns))
    steps = forecasting._stepwise(model, start, columns, 3, (), ["temperature", "weather_icon"], "overall_aqi", forecasting.rows_needed(columns), 6, ["station", "weather"])
    for r in steps.collect():
        assert list(r._made) == pytest.approx([got[r.station, h] for h in (1, 2, 3)], abs=1e-6)
