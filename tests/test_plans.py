"""Plan shape: the physical plans we want at scale."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.registry import all_queries, warehouse

QUERIES = all_queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(warehouse(spark, SF_SMALL).ref("stg_bus_routes"))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "s_suppkey" in scan and "s_acctbal" not in scan and "s_name" not in scan
    plan = _plan(warehouse(spark, SF_SMALL).ref("stg_bus_segment_speeds"))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_shipdate" in scan and "l_extendedprice" not in scan and "l_tax" not in scan


def test_staging_filters_reach_the_scan(spark):
    plan = _plan(warehouse(spark, SF_SMALL).ref("stg_traffic_volume_counts"))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "PushedFilters: [IsNotNull(o_custkey)" in scan or "IsNotNull(o_orderdate)" in scan


def test_dedup_and_topn_limit_before_shuffle(spark):
    w = warehouse(spark, SF_SMALL)
    for name in ("stg_bus_segment_speeds", "rpt_speed_bottlenecks"):
        plan = _plan(w.ref(name))
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_calendar_joins_are_broadcast(spark):
    plan = _plan(warehouse(spark, SF_SMALL).ref("fct_bus_segment_speeds"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_travel_to_the_dedup_without_texts_made_of_others(spark):
    plan = _optimized(warehouse(spark, SF_SMALL).ref("stg_bus_segment_speeds_all_years"))
    above, below = plan.split("Window [row_number()", 1)
    assert "segment_speed_id#" in above and "segment_id#" in above
    assert "segment_speed_id#" not in below and "segment_id#" not in below and "unhex(md5(" in below
    # what a task sorts fits its memory
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_one_key_for_null_and_empty_parts(spark):
    """The latest row per key, where a key's parts are null in one row and empty in another."""
    from tidewater.functions import surrogate_key
    from tidewater.plans.transit import latest_per_key, stage_speeds

    names = ["route_id", "direction", "borough", "route_type", "timepoint_stop_id", "timepoint_stop_name", "next_timepoint_stop_id",
             "next_timepoint_stop_name", "year", "month", "day_of_week", "hour_of_day", "road_distance", "average_travel_time",
             "average_road_speed", "bus_trip_count", "stop_order", "_dlt_id"]
    base = ["Q1", "N", "b", "t", "1", "one", "2", "two", "2024", "5", "Monday", "7", "1.5", "2.5", "9.5", "3", "1"]
    empty = [*base[:11], "", *base[12:]]
    nothing = [*base[:11], None, *base[12:]]
    rows = [(*base, "b", 5), (*base, "a", 5), (*base, "c", None), (*empty, "d", 1), (*nothing, "e", 2)]
    src = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", at long").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    out = latest_per_key(stage_speeds(src, "x"))
    assert out.columns[:3] == ["segment_speed_id", "route_id", "segment_id"] and "_dlt_id" not in out.columns
    kept = out.withColumn("same", F.col("segment_speed_id") == surrogate_key("route_id", "segment_id", "year", "month", "day_of_week", "hour_of_day"))
    got = sorted(((r.segment_id, r.hour_of_day, r.timestamp.second, r.same) for r in kept.collect()), key=lambda r: r[2])
    assert got == [("1-2", None, 2, True), ("1-2", "7", 5, True)]


def test_a_metric_over_the_fact_stages_the_rows_once(spark):
    from tidewater.catalog_extra import q_metric_speeds_by_route_day

    plan = _optimized(q_metric_speeds_by_route_day(warehouse(spark, SF_SMALL)))
    assert plan.count("Relation [l_orderkey") == 1
