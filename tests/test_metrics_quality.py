"""Metric layer, auto explore, checks and profiling on small frames."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.metrics import Measure, MetricsView, auto_metrics, classify_type, densify, measure_name
from tidewater.ops import auto_stage, describe_tables, diff_tables, profile, stageable_tables, table_counts
from tidewater.quality import ModelChecks, run_checks


def _facts(spark):
    rows = [(dt.date(2024, 1, d), "r1" if d % 2 else "r2", float(d), "A" if d > 3 else "B") for d in range(1, 7)]
    return spark.createDataFrame(rows, "metric_date date, route_id string, speed double, grade string")


def test_metrics_view_query_grain_filter_countif(spark):
    mv = MetricsView(_facts(spark), "metric_date", ["route_id", "grade"],
                     [Measure("avg(speed)", "Avg Speed (mph)"), Measure("countif(grade = 'A')", "Grade A Count"),
                      Measure("avg(speed) filter (where grade = 'B')", "Avg B"), Measure("count(*)", "Records")])
    out = {r.route_id: r for r in mv.query(dimensions=["route_id"], grain="month").collect()}
    assert out["r1"].avg_speed_mph == 3.0 and out["r1"].grade_a_count == 1 and out["r1"].records == 3
    assert out["r2"].avg_b == 2.0
    recent = mv.query(dimensions=[], time_range="P2D").first()
    assert recent.records == 3  # 2024-01-04 .. 2024-01-06
    assert measure_name("Avg Speed (mph)") == "avg_speed_mph"


def test_densify_keeps_every_spine_day(spark):
    spine = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11)], "date_day date")
    metric = _facts(spark).groupBy("metric_date").count().withColumnRenamed("metric_date", "date_day")
    out = densify(metric, spine)
    assert out.count() == 10 and out.where("count is null").count() == 4


def test_auto_explore_classifies_types(spark):
    df = spark.createDataFrame(
        [(1, "test", 99.5, dt.datetime(2024, 1, 1), "x", "y")],
        "id int, name string, amount double, created_at timestamp, _dlt_load_id string, _dlt_id string",
    )
    mv = auto_metrics(df)
    assert [m.name for m in mv.measures] == ["record_count", "sum_id", "avg_amount"]
    assert mv.dimensions == ["name", "created_at"] and mv.timeseries == "created_at"
    assert classify_type(T.DecimalType(10, 2)) == "avg_measure" and classify_type(T.BinaryType()) == "dimension"
    staged = auto_stage(df.withColumnRenamed("name", "Full Name"))
    assert staged.columns == ["id", "full_name", "amount", "created_at"]
    assert stageable_tables(["orders", "orders__items", "_dlt_loads", "_dlt_version"]) == ["orders"]
    desc = describe_tables(spark, {"my_table": df, "orders__items": df})
    assert desc.select("table_name").distinct().count() == 1 and desc.count() == 4


def test_checks_report(spark):
    df = spark.createDataFrame([(1, "A"), (1, "Z"), (None, "B"), (2, None)], "id int, grade string")
    rep = run_checks(lambda _: df, [ModelChecks("m", not_null=["id"], unique=["id"], accepted={"grade": ["A", "B"]})])
    got = {(r.column_name, r.check_name): (r.failing_rows, r.status) for r in rep.collect()}
    assert got == {("id", "not_null"): (1, "fail"), ("id", "unique"): (1, "fail"),
                   ("grade", "accepted_values"): (1, "fail")}


def test_counts_profile_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.25)], "id int, s string, d double")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "id int, s string")
    tc = {r.table_name: r.row_count for r in table_counts({"a": a, "b": b, "gone": None}).collect()}
    assert tc == {"a": 2, "b": 2, "gone": None}
    prof = {r.column_name: r for r in profile(a).collect()}
    assert prof["s"].null_count == 1 and prof["d"].max_value == "2.25" and prof["id"].distinct_count == 2
    d = diff_tables(a, b, ["id"]).first()
    assert (d.rows_a, d.rows_b, d.only_in_a, d.only_in_b, d.changed, d.columns_only_in_a) == (2, 2, 1, 1, 0, "d")


def test_diff_joins_only_buckets_that_differ(spark):
    from tidewater.ops import unequal_buckets

    a = spark.range(5000).select(F.col("id"), (F.col("id") * 3).alias("v"), F.lit(None).cast("string").alias("s"))
    b = a.withColumn("v", F.when(F.col("id") == 1234, -1).otherwise(F.col("v"))).repartition(5)
    assert unequal_buckets(a, b, ["id"], ["v", "s"], 1 << 12).where("differs").count() == 1
    assert unequal_buckets(a, a.repartition(3), ["id"], ["v", "s"], 1 << 12).where("differs").count() == 0
    d = diff_tables(a, b, ["id"]).first()
    assert (d.rows_a, d.rows_b, d.only_in_a, d.only_in_b, d.changed) == (5000, 5000, 0, 0, 1)
    # rows twice do not cancel out in the checksums
    twice = a.union(a.where("id = 7")).union(a.where("id = 7"))
    d = diff_tables(a, twice, ["id"]).first()
    assert (d.rows_a, d.rows_b) == (5000, 5002)
    d = diff_tables(a.limit(0), a, ["id"]).first()
    assert (d.rows_a, d.rows_b, d.only_in_a, d.only_in_b, d.changed) == (0, 5000, 0, 5000, 0)
