"""Long/wide reshaping, nested JSON to rows, dummies, and schema widening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.schema import PARAMETER_ALIASES, POLLUTANTS


def canonical_parameter(name: Column) -> Column:
    """Lower-case and unify spellings (``PM2.5``, ``pm_25`` -> ``pm25``)."""
    low = F.lower(F.trim(name))
    chain = F.when(F.lit(False), low)
    for alias, canonical in PARAMETER_ALIASES.items():
        chain = chain.when(low == alias, F.lit(canonical))
    return chain.otherwise(low)


def ensure_columns(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def long_to_wide(
    df: DataFrame, keys: Sequence[str], parameter: str, value: str, order: Sequence[str],
    parameters: Sequence[str] = tuple(POLLUTANTS),
) -> DataFrame:
    """One column per parameter holding the first value by ``order``; absent parameters become null."""
    first = F.min_by(value, F.struct(*order))
    return df.groupBy(*keys).pivot(parameter, list(parameters)).agg(first)


def mean_by_parameter(
    df: DataFrame, keys: Sequence[str | Column], parameter: str, value: str, parameters: Sequence[str]
) -> DataFrame:
    """Mean per parameter as columns, in one combined aggregation."""
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(parameter) == p, F.col(value))).alias(p) for p in parameters]
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def station_dump_rows(df: DataFrame, dump: str = "dump") -> DataFrame:
    """{station: {kind: {pollutant: [{time, value}]}}} -> (station, data_type, parameter, time, value)."""
    return station_entry_rows(
        df.select(F.explode(dump).alias("station", "kinds"))
        .select("station", F.explode("kinds").alias("data_type", "pollutants"))
        .select("station", "data_type", F.explode("pollutants").alias("parameter", "series"))
        .select("station", "data_type", "parameter", F.explode("series").alias("entry"))
    )


def station_entry_rows(entries: DataFrame) -> DataFrame:
    """Entries (maps of texts) with their three keys -> (station, data_type, parameter, time, value).

    The value may also stand under the pollutant's own name."""
    return entries.select(
        "station",
        "data_type",
        canonical_parameter(F.col("parameter")).alias("parameter"),
        F.try_element_at("entry", F.lit("time")).try_cast("timestamp_ntz").alias("time"),
        F.coalesce(F.try_element_at("entry", F.lit("value")), F.try_element_at("entry", F.col("parameter"))).try_cast("double").alias("value"),
    )


def levels(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """Distinct values, for columns made of them; refuses columns with more than ``limit``. Where there are many, models take
    the column itself as a category (``training.preparation``)."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels; take it as a category (training.preparation)")
    return sorted(row[0] for row in rows)


def one_hot(
    df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None, drop_first: bool = False
) -> DataFrame:
    """0/1 columns ``<prefix>_<level>``; ``drop_first`` leaves out the smallest level."""
    kept = list(values)[1:] if drop_first else list(values)
    return df.withColumns(
        {f"{prefix or column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in kept}
    )


def widened_type(name: str, kind: T.DataType) -> T.DataType:
    """Type of a column added to an existing table: index columns are whole numbers."""
    if name.lower().endswith("_aqi") or isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(kind, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return kind
    return T.StringType()


def widen(stored: T.StructType, incoming: DataFrame) -> DataFrame:
    """Incoming rows in the stored column order and types, with its extra columns added at the end."""
    known = {f.name: f.dataType for f in stored.fields}
    extra = {f.name: widened_type(f.name, f.dataType) for f in incoming.schema.fields if f.name not in known}
    have = {f.name: f.dataType for f in incoming.schema.fields}

    def fit(name: str, kind: T.DataType) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        source = F.col(f"`{name}`")
        if isinstance(kind, T.LongType) and isinstance(have[name], (T.DoubleType, T.FloatType)):
            source = F.bround(source, 0)
        return source.try_cast(kind).alias(name) if isinstance(have[name], T.StringType) else source.cast(kind).alias(name)

    return incoming.select(*[fit(name, kind) for name, kind in (known | extra).items()])
