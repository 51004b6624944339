"""Filling, grids, outliers, quantiles and seasonality on small series worked out by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from airgrid.operators import fill, grid, lagging, outliers, profile, season
from airgrid.operators import quantiles
from airgrid.operators.quantiles import exact_mode, exact_quantiles, quantile_row, value_counts_long, wanted_rows

GAPPY = [None, 1.0, None, None, 4.0, None, 6.0, None]


def test_interpolation_edges_and_limit(series):
    df = series({"A": GAPPY})
    assert column(fill.interpolate(df, ["v"])) == [1, 1, 2, 3, 4, 5, 6, 6]
    assert column(fill.interpolate(df, ["v"], edges="forward")) == [None, 1, 2, 3, 4, 5, 6, 6]
    assert column(fill.interpolate(df, ["v"], edges="forward", limit=1)) == [None, 1, 2, None, 4, 5, 6, 6]
    assert column(fill.interpolate(df, ["v"], edges="none")) == [None, 1, 2, 3, 4, 5, 6, None]


@pytest.mark.parametrize("gap,filled", [(1, 1), (24, 24), (25, 24)])
def test_limit_counts_rows_of_the_gap(series, gap, filled):
    df = series({"A": [0.0] + [None] * gap + [float(gap + 1)]})
    got = column(fill.interpolate(df, ["v"], edges="forward", limit=24))
    assert sum(x is not None for x in got[1:-1]) == filled


def test_time_weighted_interpolation_differs_from_positions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t, 0.0), ("A", t + dt.timedelta(hours=1), None), ("A", t + dt.timedelta(hours=4), 4.0)]
    df = spark.createDataFrame(rows, "station STRING, time TIMESTAMP_NTZ, v DOUBLE")
    assert column(fill.interpolate(df, ["v"], by="time")) == [0, 1, 4]
    assert column(fill.interpolate(df, ["v"])) == [0, 2, 4]


def test_interpolation_keeps_known_values_and_stays_between_neighbours(series):
    rng = random.Random(3)
    for _ in range(3):
        xs = [None if rng.random() < 0.5 else rng.uniform(0, 9) for _ in range(60)]
        got = column(fill.interpolate(series({"A": xs}), ["v"]))
        known = [x for x in xs if x is not None]
        assert all(g == x for g, x in zip(got, xs) if x is not None)
        assert min(known) <= min(got) and max(got) <= max(known)


def test_series_do_not_mix(series):
    df = series({"A": [None, None, 1.0], "B": [5.0, None, None]})
    assert column(fill.interpolate(df, ["v"])) == [1, 1, 1, 5, 5, 5]
    assert column(fill.carry(df, ["v"], backward=False)) == [None, None, 1, 5, 5, 5]


def test_grid_has_one_row_per_hour(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t, 1.0), ("A", t + dt.timedelta(hours=5), 2.0), ("B", t, 3.0)], "station STRING, time TIMESTAMP_NTZ, v DOUBLE")
    exposed = grid.expose_gaps(df)
    assert exposed.count() == 7 and grid.hour_grid(df).count() == 7
    assert column(exposed) == [1, None, None, None, None, 2, 3]
    ahead = grid.future_hours(df, 3).where("station = 'A'").orderBy("horizon").collect()
    assert [(r.time.hour, r.horizon) for r in ahead] == [(6, 1), (7, 2), (8, 3)]


def test_tiers(series):
    few = [1.0, None] + [float(i) for i in range(3, 23)]
    some = [1.0, None, 3.0, None, 5.0, 6.0, 7.0, 8.0]
    many = [1.0, None, None, None]
    df = series({"few": few, "some": some, "many": many})
    got = {s: column(fill.fill_by_tier(df, ["v"]).where(F.col("station") == s)) for s in ("few", "some", "many")}
    assert got["few"][1] == 2.0
    assert got["some"][1] == got["some"][3] == 5.0
    assert got["many"] == [None] * 4


def test_cascade_reaches_global_mean_and_zero(spark, series):
    df = series({"A": [2.0, None], "B": [None, None]}).withColumn("w", F.lit(None).cast("double"))
    out = fill.fill_cascade(df, ["v", "w"])
    assert column(out) == [2, 2, 2, 2] and column(out, "w") == [0, 0, 0, 0]


def test_other_fills(series):
    df = series({"A": [1.0, 2.0, 3.0, 10.0, None]})
    assert column(fill.fill_median(df, ["v"]))[-1] == 2.5
    assert column(fill.fill_mean_mode(df, ["v"]))[-1] == 4.0
    assert column(fill.fill_zero(df, ["v"]))[-1] == 0.0
    texts = series({"A": ["b", "a", "b", "a", None]}, columns="v STRING")
    assert column(fill.fill_key_mode(texts, "v"))[-1] == "a"
    assert column(fill.fill_category(texts, v="unknown"))[-1] == "unknown"
    mixed = series({"A": [None, 1.0, None]}).withColumns({"x_rolling": F.col("v"), "x_diff": F.col("v"), "x_lag": F.col("v")})
    out = fill.fill_features(mixed, ["x_rolling", "x_diff", "x_lag"]).orderBy("time").collect()
    assert [r.x_rolling for r in out] == [None, 1, 1] and [r.x_diff for r in out] == [0, 1, 0] and [r.x_lag for r in out] == [1, 1, 1]


def test_mode_and_quantiles(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x STRING")
    assert exact_mode(df, "x").first().mode == "a"
    nums = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v DOUBLE")
    assert quantile_row(nums, ["v"], {"q": 0.25}).first().v_q == 1.75


@pytest.mark.parametrize("kind", ["one", "same", "third", "wild", "ints"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    xs = {
        "one": np.array([7.5]), "same": np.full(50, 3.25), "third": np.concatenate([np.full(400, 1.0), rng.normal(size=800)]),
        "wild": np.concatenate([rng.normal(size=900), [1e12, -1e12]]), "ints": rng.integers(0, 9, 1001).astype(float),
    }[kind]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(xs)], "v DOUBLE, g INT")
    got = {r.prob: r.quantile for r in exact_quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-9)
    for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect():
        assert r.quantile == pytest.approx(np.quantile(xs[r.g :: 2], 0.5), rel=1e-9)


def test_global_cap(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(1e6,), (float("inf"),), (None,)], "v DOUBLE")
    got = [r.v for r in outliers.winsorize_global(df, ["v"]).collect()]
    xs = np.array([float(i) for i in range(101)] + [1e6])
    lo, hi = np.quantile(xs, [0.01, 0.99])
    assert max(g for g in got if g is not None) == pytest.approx(hi + 3 * (hi - lo)) and got.count(None) == 2


def test_iqr_cap_skips_negative_lower_bounds_of_some_columns(series):
    df = series({"A": [1.0, 2.0, 3.0, 4.0, 100.0, -100.0]}).withColumns({"temperature": F.col("v"), "humidity": F.col("v")})
    out = outliers.winsorize_iqr(df, ["temperature", "humidity"]).orderBy("time").collect()
    q1, q3 = np.quantile([1, 2, 3, 4, 100, -100], [0.25, 0.75])
    assert out[4].temperature == out[4].humidity == q3 + 1.5 * (q3 - q1)
    assert out[5].temperature == -100 and out[5].humidity == q1 - 1.5 * (q3 - q1)


def test_training_outliers(series):
    xs = [5.0, 6.0, 5.0, 500.0, 6.0, 5.0, 900.0]
    train = series({"A": [5.0, 6.0, 5.0, 6.0]})
    got = column(outliers.clean_training_series(series({"A": xs}), train, "v"))
    assert got[3] == 6.0 and got[6] == 5.5 and got[:3] == xs[:3]


def test_histogram_right_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (10.0,), (None,)], "v DOUBLE")
    assert [r.n for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 2]


def test_rolling_needs_a_full_window(series):
    df = series({"A": [1.0, 2.0, 3.0, 4.0, None, 6.0]})
    prev = df.withColumns(lagging.rolling("v", [3]))
    assert column(prev, "v_rolling_mean_3h") == [None, None, None, 2, 3, None]
    incl = df.withColumns(lagging.rolling("v", [3], include_current=True))
    assert column(incl, "v_rolling_mean_3h") == [None, None, 2, 3, None, None]
    assert column(df.withColumns(lagging.rolling("v", [1])), "v_rolling_std_1h") == [None] * 6


def test_folds_grow(series):
    df = lagging.expanding_folds(series({"A": [0.0] * 12}), 5)
    sizes = [df.where(f"fold < {i}").count() for i in range(1, 6)]
    assert sizes == [2, 4, 6, 8, 10] and df.where("fold = 5").count() == 2


def test_splits(series):
    df = series({"A": [0.0] * 11, "B": [0.0] * 4})
    per = lagging.split_per_key(df)
    assert per.where("is_train AND station = 'A'").count() == 8 and per.where("is_train AND station = 'B'").count() == 3
    whole = lagging.split_at_time(df)
    assert whole.where("is_train").count() == 12
    assert whole.where("is_train").agg(F.max("time")).first()[0] < whole.where("NOT is_train").agg(F.min("time")).first()[0]


def test_decomposition_recovers_a_clean_pattern(series):
    xs = [10 + 0.1 * i + (i % 24 - 11.5) for i in range(24 * 6)]
    out = season.decompose(series({"A": xs}), "v").orderBy("time").collect()
    inner = [r for r in out if r.v_trend is not None]
    assert len(inner) == 24 * 5 and out[11].v_trend is None and out[12].v_trend is not None
    assert max(abs(r.v_resid) for r in inner) < 1e-9
    assert sum(r.v_seasonal for r in out[:24]) == pytest.approx(0, abs=1e-9)


def test_partial_autocorrelation_equals_regression(series):
    rng = np.random.default_rng(1)
    x = [0.0, 0.0]
    for e in rng.normal(size=400).tolist():
        x.append(0.6 * x[-1] - 0.3 * x[-2] + e)
    got = {r.lag: r.pacf for r in season.pacf(series({"A": x}), "v", 3).collect()}
    c = np.asarray(x) - np.mean(x)
    rho = [float(c[k:] @ c[: len(c) - k] / (c @ c)) for k in range(4)]
    for k in (1, 2, 3):
        toeplitz = [[rho[abs(i - j)] for j in range(k)] for i in range(k)]
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1], abs=1e-9)


def test_unit_root_tells_noise_from_a_random_walk(series):
    rng = np.random.default_rng(2)
    e = rng.normal(size=500)
    rows = {r.station: r for r in season.unit_root(series({"noise": e.tolist(), "walk": np.cumsum(e).tolist()}), "v").collect()}
    assert rows["noise"].is_stationary and not rows["walk"].is_stationary


def test_one_far_value_does_not_gather_the_others(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LARGEST", 64)
    n = 50_000
    df = spark.range(n).select((F.col("id") / F.lit(float(n))).alias("v")).union(spark.createDataFrame([(1e9,), (float("inf"),), (-1e300,)], "v DOUBLE"))
    counts = value_counts_long(df, ["v"])
    kept = wanted_rows(counts, [0.5], ["column"], True)
    assert kept.groupBy("path").count().agg(F.max("count")).first()[0] <= 64
    got = exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]).orderBy("prob").collect()
    assert [r.quantile for r in got] == [-1e300, (n // 2) / n, float("inf")]


def test_quantiles_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g STRING, v DOUBLE")
    assert {r.g: r.quantile for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()} == {None: 2.0, "a": 5.0}
