"""Registered queries: a Spark function and, where SQL can say the same, its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.session import configure

DIGITS = 6
# Means over 16, 32, ... rows often end in an exact decimal tie, which engines round differently; both
# sides add this before rounding, which moves ties off the edge and nothing else.
OFF_TIE = 3e-10


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names the floating columns both sides round before comparison."""
    columns = doubles.split()

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(configure(spark), sf_dir)
            return df.withColumns({c: F.round(F.col(c) + F.lit(OFF_TIE), DIGITS) for c in columns}) if columns else df

        text = sql
        if sql and columns:
            text = f"SELECT * REPLACE ({', '.join(f'round({c} + {OFF_TIE}, {DIGITS}) AS {c}' for c in columns)}) FROM ({sql}) AS q"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, covers, run, text)
        return fn

    return register
