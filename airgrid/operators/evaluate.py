"""Forecast quality. All take a frame with a true and a predicted column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.functions.clock import weekday
from airgrid.functions.scales import category
from airgrid.operators.lagging import direction


def metrics(df: DataFrame, truth: str = "y", pred: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, r2, mape (over non-zero truth) and category accuracy in one aggregate."""
    known = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    err = F.col(truth) - F.col(pred)
    ss_tot = F.regr_syy(truth, truth)
    same = category(F.col(truth)) == category(F.col(pred))
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(ss_tot > 0, 1 - F.sum(err * err) / ss_tot).alias("r2"),
        (F.avg(F.when(F.col(truth) != 0, F.abs(err / F.col(truth)))) * 100).alias("mape"),
        (F.avg(same.cast("int")) * 100).alias("category_accuracy"),
    )


def directional_accuracy(
    df: DataFrame, truth: str = "y", pred: str = "p", key: str = "station", time: str = "time"
) -> DataFrame:
    """Share of steps whose sign of change agrees, per series and pooled over them."""
    marked = df.select(
        key, direction(truth, key, time).alias("_t"), direction(pred, key, time).alias("_p")
    ).where("_t IS NOT NULL AND _p IS NOT NULL")
    return marked.agg(F.count("*").alias("n"), (F.avg((F.col("_t") == F.col("_p")).cast("int")) * 100).alias("directional_accuracy"))


def category_errors(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    err = F.col(truth) - F.col(pred)
    return df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(category(F.col(truth)).alias("category")).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")
    )


def confusion(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(true_category, predicted_category, n, row_share); the window sees at most 7 x 7 rows."""
    counts = (
        df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
        .groupBy(category(F.col(truth)).alias("true_category"), category(F.col(pred)).alias("predicted_category"))
        .agg(F.count("*").alias("n"))
    )
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(W.partitionBy("true_category")))


def error_table(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    err = F.col(truth) - F.col(pred)
    return df.withColumns({"error": err, "abs_error": F.abs(err)})


def error_summary(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    return error_table(df, truth, pred).agg(
        F.avg("error").alias("mean_error"), F.stddev_samp("error").alias("std_error"),
        F.min("error").alias("min_error"), F.max("error").alias("max_error"), F.avg("abs_error").alias("mae"),
    )


def errors_by_hour(df: DataFrame, truth: str = "y", pred: str = "p", time: str = "time") -> DataFrame:
    return error_table(df, truth, pred).groupBy(F.hour(time).alias("hour")).agg(F.avg("abs_error").alias("mae"))


def errors_by_weekday(df: DataFrame, truth: str = "y", pred: str = "p", time: str = "time") -> DataFrame:
    return error_table(df, truth, pred).groupBy(weekday(F.col(time)).alias("day_of_week")).agg(F.avg("abs_error").alias("mae"))


def largest_errors(df: DataFrame, n: int = 10, truth: str = "y", pred: str = "p", ties: Sequence[str] = ()) -> DataFrame:
    return error_table(df, truth, pred).orderBy(F.desc_nulls_last("abs_error"), *ties).limit(n)


def rank_models(results: DataFrame, order: str = "run") -> DataFrame:
    """First result per model name, ranked by RMSE; results are a handful of rows."""
    first = W.partitionBy("model").orderBy(order)
    ranked = results.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    by_rmse = W.partitionBy(F.lit(0)).orderBy("rmse", "model")
    return ranked.withColumn("rank", F.row_number().over(by_rmse)).withColumn("is_best", F.col("rank") == 1)


def improvement(base: DataFrame, tuned: DataFrame, metric: str = "rmse") -> DataFrame:
    """Per model: metric before and after tuning and the gain in percent."""
    b = base.select("model", F.col(metric).alias("base"))
    t = tuned.select("model", F.col(metric).alias("tuned"))
    return b.join(t, "model").withColumn("gain_pct", (F.col("base") - F.col("tuned")) / F.col("base") * 100)


def normalise_metrics(
    results: DataFrame, lower_better: Sequence[str], higher_better: Sequence[str]
) -> DataFrame:
    """Metrics on a 0..1 scale where 1 is best, over a handful of model rows."""
    all_rows = W.partitionBy(F.lit(0))
    out = {}
    for c in lower_better:
        top = F.max(c).over(all_rows)
        out[c] = F.when(top > 0, 1 - F.col(c) / top).otherwise(F.col(c))
    for c in higher_better:
        top, low = F.max(c).over(all_rows), F.min(c).over(all_rows)
        out[c] = F.when(top > low, (F.col(c) - low) / (top - low)).otherwise(F.col(c))
    return results.withColumns({c: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for c, v in out.items()})
