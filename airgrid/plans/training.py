"""Model fitting with MLlib, tuning on expanding folds, and per-station linear models."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.operators.evaluate import metrics
from airgrid.operators.filters import attach
from airgrid.operators.lagging import expanding_folds, lags
from airgrid.plans.features import TARGET

SEED = 42
ROWS_PER_TASK = 20_000
# What boosted models are tuned over: rounds by stage of the halving, and the combinations of the first stage.
ROUNDS = (50, 100, 200)
BOOSTED_GRID = {"maxDepth": (3, 5, 7), "stepSize": (0.01, 0.05, 0.1)}


def estimators(label: str = TARGET, features: str = "features", names: Sequence[str] | None = None) -> dict[str, Estimator]:
    """The model list with its usual settings. ``boosted_subsample`` stands for the histogram booster:
    row and column subsampling of 0.8 and a smaller step."""
    common = {"labelCol": label, "featuresCol": features, "predictionCol": "raw_prediction"}
    every: dict[str, Estimator] = {
        "linear": LinearRegression(solver="normal", **common),
        "random_forest": RandomForestRegressor(numTrees=100, maxDepth=10, minInstancesPerNode=5, seed=SEED, **common),
        "gradient_boosting": GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED, **common),
        "boosted_subsample": GBTRegressor(
            maxIter=100, stepSize=0.08, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED, **common
        ),
    }
    return every if names is None else {n: every[n] for n in names}


def ridge(train: DataFrame, alpha: float = 0.5, label: str = TARGET, features: str = "features") -> LinearRegression:
    """Ridge with the usual penalty ``alpha``; MLlib divides by n and by the label's deviation."""
    row = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(
        solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / row.n * (row.sd or 1.0),
        labelCol=label, featuresCol=features, predictionCol="raw_prediction",
    )


def preparation(columns: Sequence[str], categories: Sequence[str] = ()) -> list[Estimator]:
    """Mean imputation fitted on the training rows, assembling and scaling.

    ``categories`` (such as the station) are indexed and one-hot encoded as sparse vectors, which serves
    any number of levels; for a few levels ``features.add_dummies`` makes readable columns instead.
    """
    filled = [f"_f_{c}" for c in columns]
    scaled = "_scaled" if categories else "features"
    stages: list = [
        Imputer(strategy="mean", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_assembled", handleInvalid="keep"),
        StandardScaler(inputCol="_assembled", outputCol=scaled, withMean=True, withStd=True),
    ]
    if categories:
        index, hot = [f"_i_{c}" for c in categories], [f"_h_{c}" for c in categories]
        stages += [
            StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot),
            VectorAssembler(inputCols=[scaled, *hot], outputCol="features", handleInvalid="keep"),
        ]
    return stages


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def predict(model: PipelineModel, df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Apply a fitted pipeline; an index cannot be negative."""
    scored = model.transform(as_double(df, columns))
    return scored.select(*keep, F.greatest(F.col("raw_prediction"), F.lit(0.0)).alias("prediction"))


def packed(df: DataFrame, n: int, keys: Sequence[str] = ("station", "time")) -> DataFrame:
    """``n`` rows dealt by their key over as many partitions as they fill, sorted, so that reruns agree.

    In each pass a tree fit sends the sums of all open nodes from every partition; with the partitions of the shuffles before,
    a few thousand rows cost as much as millions.
    """
    by = [k for k in keys if k in df.columns] or df.columns
    return df.repartition(max(1, -(-n // ROWS_PER_TASK)), *by).sortWithinPartitions(*by)


def fit_prepared(train: DataFrame, columns: Sequence[str], estimator: Estimator, categories: Sequence[str] = ()) -> PipelineModel:
    """One estimator behind its preparation, which is fitted on packed rows; the estimator reads vectors and the columns its
    parameters name from a cache, as a tree fit reads its rows four times before it holds them in bins of its own."""
    named = {estimator.getOrDefault(p) for p in estimator.params if p.name.endswith("Col") and estimator.isDefined(p)}
    raw, rows = packed(as_double(train, columns), train.count()).cache(), None
    try:
        front = Pipeline(stages=preparation(columns, categories)).fit(raw)
        rows = front.transform(raw).select("features", *[c for c in train.columns if not named or c in named]).cache()
        rows.count()
        raw.unpersist()
        return PipelineModel(stages=[*front.stages, estimator.fit(rows)])
    finally:
        for held in (raw, rows):
            if held is not None:
                held.unpersist()


def fit_models(
    train: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None, label: str = TARGET, with_ridge: bool = True,
    parallelism: int = 4, categories: Sequence[str] = (),
) -> dict[str, PipelineModel]:
    """Fit every model on the same prepared, cached training rows; models are fitted side by side, as
    small fits leave most of a cluster idle."""
    front = Pipeline(stages=preparation(columns, categories)).fit(as_double(train, columns))
    prepared = front.transform(packed(as_double(train, columns), train.count())).select(label, "features").cache()
    try:
        models = estimators(label, names=names)
        if with_ridge:
            models["ridge"] = ridge(prepared, label=label)
        prepared.count()
        with ThreadPoolExecutor(parallelism) as pool:
            fitted = dict(zip(models, pool.map(lambda e: e.fit(prepared), models.values())))
        return {n: PipelineModel(stages=[*front.stages, m]) for n, m in fitted.items()}
    finally:
        prepared.unpersist()


def compare(models: Mapping[str, PipelineModel], test: DataFrame, columns: Sequence[str], label: str = TARGET, keys: Sequence[str] = ()) -> DataFrame:
    """(model, metrics...) of every model on the test rows."""
    parts = [
        metrics(predict(m, test, columns, [*keys, label]), label, "prediction", keys).select(F.lit(n).alias("model"), "*")
        for n, m in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def category_levels(model: PipelineModel) -> list[tuple[str, str]]:
    """(column, level) of the one-hot places that follow the numeric columns, in the model's order; the place for
    unknown levels is the one left out."""
    indexers = [stage for stage in model.stages if isinstance(stage, StringIndexerModel)]
    return [(column, level) for stage in indexers for column, labels in zip(stage.getInputCols(), stage.labelsArray) for level in labels]


def importances(model: PipelineModel, columns: Sequence[str], spark: SparkSession, top: int | None = None, of: str | None = None) -> DataFrame:
    """(feature, importance) of a tree model; linear models give absolute coefficients. ``of`` names the category whose levels
    alone are wanted, as the station."""
    last = model.stages[-1]
    weights = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    names = [*((None, c) for c in columns), *((c, f"{c}_{level}") for c, level in category_levels(model))]
    frame = spark.createDataFrame(
        [(n, float(w)) for (c, n), w in zip(names, weights, strict=True) if of is None or c == of], "feature STRING, importance DOUBLE"
    ).orderBy(F.desc("importance"), "feature")
    return frame.limit(top) if top else frame


def grid_search(
    df: DataFrame, columns: Sequence[str], make: Mapping[str, object] | object, grid: Mapping[str, Sequence], folds: int = 5,
    label: str = TARGET, parallelism: int = 4, categories: Sequence[str] = (),
) -> list[dict]:
    """Mean RMSE of every parameter combination over expanding time folds, best first.

    ``make(**params)`` builds an estimator. What a fold learns (means, scales, levels) is fitted on its own past, once for all
    combinations. Combinations run in parallel as Spark jobs of their own.
    """
    with prepared_folds(df, columns, folds, label, categories) as splits:
        combos = [dict(zip(grid, values)) for values in product(*grid.values())]
        return ranked_over_folds(splits, make, combos, label, parallelism)


@contextmanager
def prepared_folds(
    df: DataFrame, columns: Sequence[str], folds: int, label: str, categories: Sequence[str]
) -> Iterator[list[tuple[DataFrame, DataFrame]]]:
    """(training rows, test rows) per fold as cached vectors, which every combination reads."""
    folded = packed(expanding_folds(as_double(df, columns), folds), df.count()).cache()
    held = [folded]

    def split(i: int) -> tuple[DataFrame, DataFrame]:
        train, test = folded.where(F.col("fold") < i), folded.where(F.col("fold") == i)
        front = Pipeline(stages=preparation(columns, categories)).fit(train)
        parts = tuple(front.transform(part).select(label, "features").cache() for part in (train, test))
        held.extend(parts)
        for part in parts:
            part.count()
        return parts

    try:
        folded.count()  # the threads below read the cached rows
        with ThreadPoolExecutor(folds) as pool:
            splits = list(pool.map(split, range(1, folds + 1)))
        folded.unpersist()
        yield splits
    finally:
        for part in held:
            part.unpersist()


def ranked_over_folds(splits: list[tuple[DataFrame, DataFrame]], make, combos: Sequence[dict], label: str, parallelism: int) -> list[dict]:
    def rmse(job: tuple[dict, tuple[DataFrame, DataFrame]]) -> float:
        params, (train, test) = job
        scored = make(**params).fit(train).transform(test).select(label, F.greatest("raw_prediction", F.lit(0.0)).alias("prediction"))
        return metrics(scored, label, "prediction").first()["rmse"]

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(rmse, product(combos, splits)))
    n = len(splits)
    results = [{"params": params, "rmse": float(np.mean(scores[i * n : (i + 1) * n]))} for i, params in enumerate(combos)]
    return sorted(results, key=lambda r: r["rmse"])


def boosted(rounds: int, label: str = TARGET, **params) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, seed=SEED, labelCol=label, featuresCol="features", predictionCol="raw_prediction", **params)


def tune_boosted(
    df: DataFrame, columns: Sequence[str], grid: Mapping[str, Sequence] = BOOSTED_GRID, rounds: Sequence[int] = ROUNDS, folds: int = 5,
    label: str = TARGET, parallelism: int = 4, categories: Sequence[str] = (),
) -> list[dict]:
    """Successive halving of boosted models: all combinations with few rounds over expanding time folds, the better half again
    with more, and so on. Returns (stage, rounds, params, rmse, rank), the last stage's best first; the folds are prepared once."""
    with prepared_folds(df, columns, folds, label, categories) as splits:
        combos, out = [dict(zip(grid, values)) for values in product(*grid.values())], []
        for stage, n in enumerate(rounds):
            results = ranked_over_folds(splits, lambda n=n, **p: boosted(n, label, **p), combos, label, parallelism)
            out = [{"stage": stage, "rounds": n, "rank": i + 1, **r} for i, r in enumerate(results)] + out
            combos = [r["params"] for r in results[: max(1, len(results) // 2)]]
        return out


def fit_boosted(df: DataFrame, columns: Sequence[str], params: Mapping, most: int = ROUNDS[-1], held: float = 0.8, label: str = TARGET, categories: Sequence[str] = ()) -> tuple[PipelineModel, int]:
    """A boosted model that stops when the newest rows (behind the ``held`` quantile of the time, at a whole hour) no longer gain; and its rounds.

    Any gain counts: a round of a small step gains less than a tolerance of half a percent, which would end the model at its start.
    """
    front = Pipeline(stages=preparation(columns, categories)).fit(as_double(df, columns))
    hour = df.select(F.unix_micros(F.col("time").cast("timestamp")).alias("t")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    bound = F.timestamp_micros(F.lit(int(hour.lo + (hour.hi - hour.lo) * held))).cast("timestamp_ntz")
    rows = front.transform(packed(as_double(df, columns), df.count())).select(label, "features", (F.col("time") >= F.date_trunc("hour", bound)).alias("_held")).cache()
    try:
        model = boosted(most, label, validationIndicatorCol="_held", validationTol=0.0, **params).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*front.stages, model]), model.getNumTrees


def gram(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Per key the sums that define a least-squares fit: one combined aggregate, no raw rows gathered."""
    names = [*features, label]
    known = df.na.drop("any", subset=names)
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return known.groupBy(key).agg(
        F.count("*").alias("n"), F.array(*[F.sum(a) for a in names]).alias("s1"), F.array(*sums).alias("s2")
    )


def grouped_least_squares(df: DataFrame, features: Sequence[str], label: str, key: str = "station", alpha: float = 0.0) -> DataFrame:
    """One linear model per key from its sums: (key, n, intercept, coefficients).

    All keys are fitted by one job; only a small square system per key is solved in Python.
    """
    d = len(features)

    @F.pandas_udf("intercept DOUBLE, coefficients ARRAY<DOUBLE>")
    def solve(n: pd.Series, s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        rows = []
        upper = np.triu_indices(d + 1)
        for count, first, second in zip(n, s1, s2):
            moments = np.zeros((d + 1, d + 1))
            moments[upper] = second
            moments = moments + moments.T - np.diag(np.diag(moments))
            mean = np.asarray(first, dtype=float) / count
            centred = moments - count * np.outer(mean, mean)
            beta = np.linalg.lstsq(centred[:d, :d] + alpha * np.eye(d), centred[:d, d], rcond=None)[0]
            rows.append((mean[d] - beta @ mean[:d], beta.tolist()))
        return pd.DataFrame(rows, columns=["intercept", "coefficients"])

    return gram(df, features, label, key).select(key, "n", solve("n", "s1", "s2").alias("m")).select(key, "n", "m.*")


def apply_grouped(df: DataFrame, models: DataFrame, features: Sequence[str], key: str = "station", least: float | None = 0.0) -> DataFrame:
    """Score rows with their key's linear model as a plain expression, not below ``least``."""
    terms = [F.col("coefficients")[i] * F.col(f) for i, f in enumerate(features)]
    joined = df.join(models.select(key, "intercept", "coefficients"), key, "left")
    value = reduce(lambda a, b: a + b, terms, F.col("intercept"))
    return joined.withColumn("prediction", value if least is None else F.greatest(value, F.lit(least))).drop("intercept", "coefficients")


def autoregression(df: DataFrame, column: str, order: int = 4, key: str = "station") -> tuple[DataFrame, DataFrame, list[str]]:
    """AR(order) per key: the frame with its lags, the fitted coefficients and the lag names."""
    names = lags(column, range(1, order + 1))
    lagged = df.withColumns(names)
    return lagged, grouped_least_squares(lagged, list(names), column, key), list(names)


def fourier_terms(df: DataFrame, time: str = "time", daily: int = 4, weekly: int = 3) -> tuple[DataFrame, list[str]]:
    """Sine/cosine pairs of the day and the week plus a linear trend in days."""
    from airgrid.functions.clock import epoch_seconds

    seconds = epoch_seconds(F.col(time))
    columns = {"trend_days": seconds / F.lit(86_400.0) - F.lit(19_000.0)}
    for name, period, n in (("day", 86_400, daily), ("week", 604_800, weekly)):
        for i in range(1, n + 1):
            angle = (seconds % period) * F.lit(2 * np.pi * i / period)
            columns[f"{name}_sin_{i}"], columns[f"{name}_cos_{i}"] = F.sin(angle), F.cos(angle)
    return df.withColumns(columns), list(columns)


def seasonal_regression(
    df: DataFrame, column: str, exogenous: Sequence[str] = (), key: str = "station", daily: int = 4, weekly: int = 3, alpha: float = 1e-6
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Trend, daily and weekly seasonality and exogenous columns per key, as one least-squares job."""
    framed, names = fourier_terms(df, daily=daily, weekly=weekly)
    names = [*names, *exogenous]
    return framed, grouped_least_squares(framed, names, column, key, alpha), names


def guard(pred: DataFrame, train: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Reject implausible predictions: mean or deviation over five times the training one, or an RMSE
    over five training deviations. One row per key with ``accepted``."""
    fitted = train.groupBy(*keys).agg(F.avg(label).alias("_mean"), F.stddev_pop(label).alias("_sd"))
    err = F.col(label) - F.col("prediction")
    seen = pred.groupBy(*keys).agg(
        F.avg("prediction").alias("mean_pred"), F.stddev_pop("prediction").alias("sd_pred"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )
    both = seen.join(fitted, list(keys)) if keys else attach(seen, fitted)
    bad = (F.abs("mean_pred") > 5 * F.abs("_mean")) | (F.col("sd_pred") > 5 * F.col("_sd")) | (F.col("rmse") > 5 * F.col("_sd"))
    return both.withColumn("accepted", ~bad).drop("_mean", "_sd")


def fit_per_station(
    df: DataFrame, stations: Sequence[str], columns: Sequence[str], make, label: str = TARGET, parallelism: int = 4
) -> dict[str, PipelineModel]:
    """One MLlib model per station for models without a closed form; stations run as parallel jobs."""

    def one(station: str) -> PipelineModel:
        return fit_prepared(df.where(F.col("station") == station), columns, make())

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(stations, pool.map(one, stations)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_metrics(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
