"""Exact quantiles and modes that never gather a group's raw values in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer. That is right
for an hourly series (bounded by the calendar) and wrong for raw readings. ``exact_quantiles`` counts
distinct values first (partially combined, spread by value), then cuts the value range into bins, finds
the bins that hold the wanted ranks, and orders only those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.session import cut_lineage

BINS = 4096
LARGEST = 1 << 16  # rows that are ordered in one task


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value) with nulls dropped; one pass over the input."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.column", "p.value").where(
        F.col("value").isNotNull()
    )


def value_counts_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value, n): every distinct value once, spread by value."""
    return to_long(df, columns, keys).groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """Inner join in which a null key equals a null key."""
    renamed = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(F.broadcast(renamed) if small else renamed, same).drop(*[f"_key_{k}" for k in keys])


def _finite() -> Column:
    """Halves, as the whole range may exceed a double; infinities and NaN must not stretch the range."""
    return F.when(F.abs("value") < F.lit(float("inf")), F.col("value") / 2)


def _span() -> list[Column]:
    return [F.min(_finite()).alias("lo"), F.max(_finite()).alias("hi")]


def narrowed(rows: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Cut each group's value range [lo, hi] into bins and keep the bins that hold one of the group's wanted ranks.

    ``rows``: (by..., path, value, n, lo, hi, before, wanted); a bin becomes a group of its own.
    """
    group, value = [*by, "path"], F.col("value")
    share = (value / 2 - F.col("lo")) / (F.col("hi") - F.col("lo"))
    place = (
        F.when(value == F.lit(float("-inf")), 0).when(_finite().isNull() | F.isnan(value), BINS - 1)
        .when(F.col("hi") > F.col("lo"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0)
    )
    binned = rows.withColumn("bin", place.cast("long")).drop("lo", "hi")
    running = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    totals = binned.groupBy(*group, "bin").agg(F.sum("n").alias("held"), F.first("before").alias("start"), F.first("wanted").alias("asked"))
    totals = totals.withColumn("upto", F.col("start") + F.sum("held").over(running))
    first = F.col("upto") - F.col("held")
    hits = totals.select(
        *group, "bin", first.alias("before"), F.filter("asked", lambda t: (t["rank"] >= first) & (t["rank"] < F.col("upto"))).alias("wanted"),
    ).where(F.size("wanted") > 0)
    kept = join_null_safe(binned.drop("before", "wanted"), hits, [*group, "bin"], small)
    return kept.select(*by, (F.col("path") * BINS + F.col("bin")).alias("path"), "value", "n", "before", "wanted")


def wanted_rows(counts: DataFrame, probs: Sequence[float], by: Sequence[str], few_groups: bool) -> DataFrame:
    """The rows among which the wanted ranks are. One round of bins is enough for most data; where a far value
    makes too many others fall into one bin, that bin is cut again. Each round's rows, few next to the counts,
    are written to the shared folder, as the next round reads them twice."""
    targets = []
    for p in probs:
        position = F.lit(float(p)) * (F.col("total") - 1)
        frac = position - F.floor(position)
        targets += [
            F.struct(F.lit(float(p)).alias("prob"), frac.alias("frac"), rank.alias("rank"))
            for rank in (F.floor(position), F.ceil(position))
        ]
    asked = counts.groupBy(*by).agg(F.sum("n").alias("total"), *_span()).select(*by, "lo", "hi", F.array(*targets).alias("wanted"))
    zero = F.lit(0).cast("long")
    rows = join_null_safe(counts.select(*by, "value", "n"), asked, by, few_groups).withColumns({"path": zero, "before": zero})
    while True:
        rows = cut_lineage(narrowed(rows, by, few_groups))
        if (rows.groupBy(*by, "path").count().agg(F.max("count")).first()[0] or 0) <= LARGEST:
            return rows
        group = [*by, "path"]
        rows = join_null_safe(rows, rows.groupBy(*group).agg(*_span()), group, few_groups)


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], by: Sequence[str], value: str = "value", n: str = "n", few_groups: bool = False,
) -> DataFrame:
    """Quantiles from a (by..., value, n) table: one row per ``by`` and probability; a null in ``by`` is a group.

    Linear interpolation between the two neighbouring ranks, as pandas and SQL ``percentile_cont`` do.
    ``few_groups`` says that the number of groups is a small constant of the query (its columns, not its
    keys); then the per-group tables have at most 2 x probabilities rows per group and are broadcast.
    """
    by = list(by)
    rows = wanted_rows(counts.withColumnsRenamed({value: "value", n: "n"}), probs, by, few_groups)
    inside = W.partitionBy(*by, "path").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("last", F.col("before") + F.sum("n").over(inside))
    at = F.filter("wanted", lambda t: (t["rank"] >= F.col("last") - F.col("n")) & (t["rank"] < F.col("last")))
    found = ranked.select(*by, F.col("value").alias("_v"), F.explode(at).alias("t"))
    low, high = F.min("_v"), F.max("_v")
    return found.groupBy(*by, F.col("t.prob").alias("prob")).agg(
        F.when(low == high, low).otherwise(low + (high - low) * F.max("t.frac")).alias("quantile")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, column, prob, quantile) for every column and probability, nulls ignored."""
    return quantiles_of_counts(value_counts_long(df, columns, keys), probs, [*keys, "column"], few_groups=not keys)


def quantile_row(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row with ``<column>_<name>`` for each named probability."""
    long = exact_quantiles(df, columns, sorted(set(probs.values())))
    picks = [
        F.max(F.when((F.col("column") == c) & (F.col("prob") == F.lit(float(p))), F.col("quantile"))).alias(f"{c}_{name}")
        for c in columns
        for name, p in probs.items()
    ]
    return long.agg(*picks)


def exact_mode(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value, smallest among ties, nulls ignored; two combined aggregations."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best.getField("v").alias(name))


def vocabulary_mode(column: Column | str) -> Column:
    """Mode as an aggregate expression, for columns with a small vocabulary (icons, categories)."""
    return F.mode(column, True)
