"""Column profiles and report aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.operators.quantiles import quantiles_of_counts, value_counts_long
from airgrid.operators.scalars import with_row


def unfold(row: DataFrame, entries: dict[str, dict[str, Column]], label: str = "column") -> DataFrame:
    """One wide aggregate row -> one row per entry, with the entry's named values as columns."""
    items = [
        F.struct(F.lit(name).alias(label), *[value.alias(out) for out, value in values.items()])
        for name, values in entries.items()
    ]
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, pct_null) in one pass."""
    row = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]
    )
    return unfold(
        row,
        {c: {"n_null": F.col(f"`{c}`"), "pct_null": F.col(f"`{c}`") * 100.0 / F.col("_n")} for c in columns},
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    # One table of counts gives all figures, so the source is read once.
    counts = value_counts_long(df, columns)
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    off = F.col("value") - F.col("mean")
    spread = counts.withColumnRenamed("n", "_n").join(F.broadcast(sums), "column").groupBy("column").agg(F.sum(off * off * F.col("_n")).alias("_squares"))
    moments = sums.join(spread, "column").withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1))))
    cuts = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["column"], few_groups=True)
    pick = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    wide = cuts.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in pick.items()]
    )
    return moments.join(wide, "column", "left").select(
        "column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, dtype, n_distinct); values are counted in long text form so one shuffle serves all columns."""
    kinds = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("v").isNotNull()).distinct()
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return (
        seen.groupBy("column").agg(F.count("*").alias("n_distinct")).withColumn("dtype", dtype[F.col("column")])
    )


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name)).orderBy(F.desc(name), *columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation, nulls ignored per pair, as (left, right, corr); one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = []
    for a in columns:
        for b in columns:
            key = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
            value = F.lit(1.0) if a == b else F.col(f"`{key}`")
            items.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), value.alias("corr")))
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def target_correlation(df: DataFrame, features: Sequence[str], target: str, top: int | None = None) -> DataFrame:
    row = df.agg(*[F.corr(f, target).alias(f) for f in features])
    ranked = unfold(row, {f: {"corr": F.col(f)} for f in features}, "feature").orderBy(
        F.desc_nulls_last("corr"), "feature"
    )
    return ranked.limit(top) if top else ranked


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) for equal-width bins; the right edge counts into the last bin, empty bins stay."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    low = F.col("_row")["lo"]
    width = (F.col("_row")["hi"] - low) / F.lit(float(bins))
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = (
        with_row(df.where(F.col(column).isNotNull()), edges)
        .select(F.coalesce(at, F.lit(0)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    every = with_row(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), edges)
    return every.join(counted, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """q1, median, q3 and whiskers (extreme values within 1.5 IQR of the box) per group of an hourly series.

    One group holds at most one row per hour, so the quartiles may use Spark's own ``percentile``.
    """
    by = W.partitionBy(*keys)
    quart = df.withColumn("_q", F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(by))
    box = quart.withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return box.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(F.col(value).isNotNull() & ~inside).alias("n_outside"),
    )


def linear_fit(df: DataFrame, target: str, variable: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(target, variable).alias("slope"), F.regr_intercept(target, variable).alias("intercept"),
        F.regr_count(target, variable).alias("n"),
    )


def interval_audit(df: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """How often each step between successive (hourly) rows occurs, in hours."""
    step = F.timestamp_diff("HOUR", F.lag(time).over(W.partitionBy(key).orderBy(time)), F.col(time))
    return (
        df.select(key, step.alias("step_hours"))
        .where(F.col("step_hours").isNotNull())
        .groupBy("step_hours")
        .agg(F.count("*").alias("n"))
    )


def overview(df: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """Row count, time range and list of keys, one row; keys are combined before they are listed."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
        F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("keys"),
    )


def key_summary(df: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """Count, first and last time, number of distinct days; distinct days are combined per (key, day)."""
    days = df.groupBy(key, F.to_date(time).alias("_day")).agg(
        F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")
    )
    return days.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
        F.count("_day").alias("n_days"),
    )


def null_mask_sample(df: DataFrame, columns: Sequence[str], time: str, key: str, rows: int = 1000) -> DataFrame:
    """Null mask of every n-th row in (time, key) order, about ``rows`` of them, for drawing.

    A row's global position is the number of rows in earlier hours plus its place inside its hour, so
    only the per-hour counts are ordered globally.
    """
    per_hour = df.groupBy(time).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(time).rowsBetween(W.unboundedPreceding, -1))
    offsets = per_hour.select(time, F.coalesce(before, F.lit(0)).alias("_before"))
    total = df.agg(F.count("*").alias("n")).scalar()
    step = F.greatest(F.lit(1), F.floor(total / F.lit(rows)))
    placed = df.join(offsets, time).withColumn(
        "position", F.col("_before") + F.row_number().over(W.partitionBy(time).orderBy(key)) - 1
    )
    return placed.where(F.col("position") % step == 0).select(
        "position", time, key, *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns]
    )
