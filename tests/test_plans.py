"""Physical plans: what must not appear in them."""

import re

import pytest

from airgrid.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    df = REGISTRY[name].run(spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hourly_station_mean", "aqi_rounded", "rolling_prev", "interpolate_time", "merge_sources", "winsorize_global", "calendar_features"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hourly_mean_combines_before_its_only_shuffle(spark):
    text = plan(spark, "hourly_station_mean")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "partial_avg" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>", text)


def test_feature_windows_share_one_exchange(spark):
    """Hourly means shuffle by (station, hour), all windows after that by station: two in total."""
    for name in ("rolling_prev", "lag_features", "rolling_incl"):
        assert len(re.findall(r"Exchange hashpartitioning", plan(spark, name))) == 2, name


def test_filters_reach_the_scan(spark):
    df = REGISTRY["partitioned_scan"].run(spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*date.*2024-01-10", text)
    text = plan(spark, "daily_min_max")
    assert "user_id" in text and "props" not in text


def test_city_weather_is_broadcast(spark):
    text = plan(spark, "weather_broadcast_join")
    assert "BroadcastHashJoin" in text


def test_latest_rows_are_aggregated_not_sorted(spark):
    text = plan(spark, "latest_per_station")
    assert "Window" not in text and "partial_max_by" in text


def test_levels_refuse_columns_with_many_values(spark):
    from airgrid.operators import reshape

    ids = spark.range(1001).selectExpr("cast(id AS STRING) AS k")
    with pytest.raises(ValueError, match="more than 1000 levels"):
        reshape.levels(ids, "k")
    assert len(reshape.levels(ids.limit(1000), "k")) == 1000
