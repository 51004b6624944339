"""Gap filling on hourly series: carry, interpolate, and the imputation policies.

Every window here partitions by station over an hourly frame (one row per hour at most). "Next known
value" is read with a descending window, because a frame that runs to the end of the partition is
re-evaluated for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.functions.clock import epoch_micros
from airgrid.operators.quantiles import exact_mode, quantile_row
from airgrid.operators.scalars import with_row


def _windows(key: str | None, time: str):
    part = W.partitionBy(key) if key else W.partitionBy(F.lit(0))
    back = part.orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    ahead = part.orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, 0)
    return part, back, ahead


def carry(
    df: DataFrame, columns: Sequence[str], key: str | None = "station", time: str = "time",
    forward: bool = True, backward: bool = True,
) -> DataFrame:
    """Forward fill, then fill what is left backwards. ``key=None`` is for one city-wide series."""
    _, back, ahead = _windows(key, time)
    filled = {}
    for c in columns:
        parts = [F.col(c)]
        parts += [F.last(c, ignorenulls=True).over(back)] if forward else []
        parts += [F.last(c, ignorenulls=True).over(ahead)] if backward else []
        filled[c] = F.coalesce(*parts)
    return df.withColumns(filled)


def interpolate(
    df: DataFrame, columns: Sequence[str], key: str | None = "station", time: str = "time",
    by: str = "position", edges: str = "both", limit: int | None = None,
) -> DataFrame:
    """Linear interpolation between the neighbouring known values.

    ``by``: ``position`` (row number) or ``time``. ``edges``: ``both`` extends the first and last known
    value outwards, ``forward`` only the last, ``none`` neither. ``limit`` fills at most that many rows
    after a known value.
    """
    part, back, ahead = _windows(key, time)
    frame = df.withColumn("_pos", F.row_number().over(part.orderBy(time)))
    frame = frame.withColumn("_x", F.col("_pos") if by == "position" else epoch_micros(F.col(time)))
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("x"), F.col("_pos").alias("i"), F.col(c).alias("v"))) for c in columns}
    frame = frame.withColumns({f"_prev_{c}": F.last(point[c], ignorenulls=True).over(back) for c in columns})
    frame = frame.withColumns({f"_next_{c}": F.last(point[c], ignorenulls=True).over(ahead) for c in columns})

    def filled(c: str) -> Column:
        pv, nv = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col("_x") - pv["x"]) / (nv["x"] - pv["x"])
        inner = pv["v"] + (nv["v"] - pv["v"]) * share
        options = [F.col(c), F.when(pv.isNotNull() & nv.isNotNull() & (nv["x"] > pv["x"]), inner)]
        options += [pv["v"]] if edges in ("both", "forward") else []
        options += [nv["v"]] if edges == "both" else []
        value = F.coalesce(*options)
        if limit is None:
            return value
        near = F.when(pv.isNotNull(), F.col("_pos") - pv["i"] <= limit).otherwise(F.lit(edges == "both"))
        return F.when(F.col(c).isNotNull() | near, value)

    out = frame.withColumns({c: filled(c) for c in columns})
    return out.select(*df.columns)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the exact global median of each column."""
    joined = with_row(df, quantile_row(df, columns, {"med": 0.5}), "_mid")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col("_mid")[f"{c}_med"]) for c in columns}).drop("_mid")


def fill_mean_mode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Fill numbers with the global mean and categories with the global mode."""
    out = df
    if numeric:
        out = with_row(out, df.agg(*[F.avg(c).alias(c) for c in numeric]), "_means")
        out = out.withColumns({c: F.coalesce(F.col(c), F.col("_means")[c]) for c in numeric}).drop("_means")
    for c in categorical:
        out = out.withColumn(c, F.coalesce(F.col(c), exact_mode(df, c, name="m").scalar()))
    return out


def fill_key_mode(df: DataFrame, column: str, key: str = "station", max_null_share: float | None = None) -> DataFrame:
    """Fill a category with its key's mode; above ``max_null_share`` the whole key's column is nulled."""
    by_key = W.partitionBy(key)
    value = F.coalesce(F.col(column), F.mode(column, True).over(by_key))
    if max_null_share is not None:
        value = F.when(F.avg(F.col(column).isNull().cast("int")).over(by_key) <= max_null_share, value)
    return df.withColumn(column, value)


def fill_by_tier(
    df: DataFrame, columns: Sequence[str], key: str = "station", time: str = "time",
    few: float = 0.1, many: float = 0.5,
) -> DataFrame:
    """Per (key, column): null share over ``many`` -> all null, from ``few`` up -> mean, below -> time
    interpolation with flat edges."""
    by_key = W.partitionBy(key)
    known = df.withColumns(
        {f"_share_{c}": F.avg(F.col(c).isNull().cast("int")).over(by_key) for c in columns}
        | {f"_mean_{c}": F.coalesce(F.col(c), F.avg(c).over(by_key)) for c in columns}
    )
    joined = interpolate(known, columns, key, time, by="time", edges="both")

    def pick(c: str) -> Column:
        share = F.col(f"_share_{c}")
        return F.when(share > many, F.lit(None).cast("double")).when(share >= few, F.col(f"_mean_{c}")).otherwise(F.col(c))

    return joined.withColumns({c: pick(c) for c in columns}).select(*df.columns)


def fill_cascade(df: DataFrame, columns: Sequence[str], key: str = "station") -> DataFrame:
    """Own value, else the key's mean, else the global mean, else zero."""
    by_key = W.partitionBy(key)
    joined = with_row(df, df.agg(*[F.avg(c).alias(c) for c in columns]), "_all")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.avg(c).over(by_key), F.col("_all")[c], F.lit(0.0)) for c in columns}
    ).drop("_all")


def fill_weather(
    df: DataFrame, numeric: Sequence[str], icon: str, key: str | None = None, time: str = "time"
) -> DataFrame:
    """Continuous weather: interpolate numbers both ways, carry the icon both ways.

    What is still null then belongs to a series without any value, whose mean and mode are null too, so
    no further fill can change anything.
    """
    return carry(interpolate(df, numeric, key, time, edges="both"), [icon], key, time)


def fill_features(
    df: DataFrame, columns: Sequence[str], key: str = "station", time: str = "time"
) -> DataFrame:
    """After feature building: rolling columns carry forward, differences get 0, the rest the key's mean."""
    rolling = [c for c in columns if "rolling" in c]
    diffs = [c for c in columns if "diff" in c and c not in rolling]
    rest = [c for c in columns if c not in rolling and c not in diffs]
    out = carry(df, rolling, key, time, backward=False) if rolling else df
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in diffs}) if diffs else out
    if rest:
        by_key = W.partitionBy(key)
        out = out.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(by_key)) for c in rest})
    return out


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def fill_target_and_features(
    df: DataFrame, target: str, features: Sequence[str], key: str = "station", time: str = "time"
) -> DataFrame:
    """Target: forward then backward fill. Features: interpolate, then flat edges."""
    return interpolate(carry(df, [target], key, time), features, key, time, edges="both")


def fill_category(df: DataFrame, **defaults: str) -> DataFrame:
    return df.fillna(defaults)
