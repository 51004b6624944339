"""One-row statistics used next to every row, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_struct(stats: DataFrame) -> Column:
    """A global aggregate (exactly one row) as a scalar subquery; read its fields with ``.getField``.

    Spark runs the subquery once and puts the value into the plan as a literal, so the big side is
    neither shuffled nor joined.
    """
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("s")).scalar()


def with_row(df: DataFrame, stats: DataFrame, name: str = "_row") -> DataFrame:
    """The one row of ``stats`` as a struct column. Reading its fields afterwards keeps a single copy of
    the subquery in the plan, however many fields are used."""
    return df.withColumn(name, as_struct(stats))
