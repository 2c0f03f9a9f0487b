"""Shapes of physical plans that must hold at scale."""

import re

import pytest

from hourlake.catalog.views import Views
from hourlake.operators import features, quality, ranking

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, DIR)


def test_feature_windows_share_one_shuffle(v):
    base = v.stored("series", features.one_per_hour(features.prefer(v.joined)))
    cols = ["temperature", "humidity"]
    df = base.select("*", *[c.alias(n) for n, c in {**features.lag_columns(cols), **features.rolling_columns(cols),
                                                    **features.target_columns(cols)}.items()])
    p = plan(df)
    assert p.count("Exchange") == 1 and len(re.findall(r"\bSort \[", p)) == 1


@pytest.mark.parametrize("name", ["j5_resolve_entities", "j8_select_station", "j9_nearest_obs", "j11_accessible_sources", "j13_attach_thresholds"])
def test_no_nested_loops(spark, name):
    import __spark_entry__ as entry

    p = plan(entry.queries()[name](spark, DIR))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(v):
    p = plan(v.read("events").where("event_type = 'click'").select("value"))
    assert "EqualTo(event_type,click)" in p and "ReadSchema: struct<event_type:string,value:double>" in p
    assert "StringStartsWith" in plan(quality.filter_location_set(v.stored("ref", v.reference), "current").select("event_ts"))


def test_rank_is_limited_before_the_shuffle(v):
    p = plan(ranking.latest_per(v.metrics, ["sensor_id"], "event_ts", ["id"]))
    assert p.count("WindowGroupLimit") == 2


def test_rollup_aggregates_before_the_shuffle(v):
    assert "partial_avg" in plan(v.hourly)


@pytest.mark.parametrize("name,most", [("s6_parse_sensor_json", 1), ("s7_parse_station_json", 2)])
def test_messages_are_parsed_once(spark, name, most):
    import __spark_entry__

    names = [q for q in __spark_entry__.queries() if q.startswith(name[:3])]
    plan = __spark_entry__.queries()[name if name in names else names[0]](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json") <= most and plan.count("get_json_object") <= 1
