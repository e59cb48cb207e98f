"""Report models over the transit facts.

Every report ends in a small aggregate; global rankings (single-partition
windows) only ever see those aggregated rows.  Rounding uses
:func:`round_half` so values equal the reference engine's ``round``.
Row-number ties are broken by the group keys (deterministic output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import bucket_order, bucketize, round_half, two_class
from tidewater.operators import (
    add_rank,
    avg_where,
    count_where,
    distribution_stats,
    lookup_join,
    pct_where,
    period_over_period,
    pivot_max,
    share_of_group,
    top_n_per_group,
    weighted_avg,
)
from tidewater.plans.calendar import CALENDAR_ROWS
from tidewater.plans.core import Warehouse, model

c = F.col


def _r2(x):
    return round_half(x, 2)


def _routes(w: Warehouse, *cols: str) -> DataFrame:
    return w.ref("dim_bus_routes").select("route_id", *cols)


def _with_routes(fact: DataFrame, w: Warehouse, *cols: str) -> DataFrame:
    """Left join route attributes; they replace same-named fact columns
    (the fact's ``borough`` is the feed's own code, reports use the route's)."""
    return lookup_join(fact.drop(*cols), _routes(w, *cols), "route_id", "left")


@model("rpt_borough_comparison", layer="table")
def rpt_borough_comparison(w: Warehouse) -> DataFrame:
    rp = w.ref("fct_route_daily_performance").where(c("borough") != F.lit("Unknown"))
    g = c("reliability_grade")
    agg = rp.groupBy("borough").agg(
        _r2(F.avg("route_avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("total_trips").alias("total_trips"),
        F.count_distinct("route_id").alias("route_count"),
        F.count_distinct("metric_date").alias("observation_days"),
        pct_where(g == F.lit("A")).alias("pct_grade_a"),
        pct_where(g.isin("A", "B")).alias("pct_grade_a_or_b"),
    )
    ranked = add_rank(agg, [c("avg_speed_mph").desc_nulls_last(), c("borough").asc_nulls_last()], "speed_rank")
    return ranked.orderBy("speed_rank")


@model("rpt_bus_lane_effectiveness", layer="table")
def rpt_bus_lane_effectiveness(w: Warehouse) -> DataFrame:
    s = w.ref("fct_segment_speeds_hourly").select("time_period", "hour_of_day", "segment_id", "avg_speed_mph")
    # Segment-only join to a segment x route match: weight instead of fan-out
    # (see fct_corridor_performance).
    lm = (
        w.ref("int_segment_bus_lane_match")
        .groupBy("segment_id", "has_bus_lane", "lane_type")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    j = s.join(lm, "segment_id", "inner")
    grouped = j.groupBy("time_period", "hour_of_day", "has_bus_lane", "lane_type").agg(
        _r2(weighted_avg("avg_speed_mph", "_w")).alias("avg_speed_mph"),
        F.count_distinct("segment_id").alias("segment_count"),
    )
    lane, no_lane = c("has_bus_lane"), ~c("has_bus_lane")
    piv = pivot_max(
        grouped,
        ["time_period", "hour_of_day"],
        {
            "bus_lane_avg_speed": (lane, "avg_speed_mph"),
            "no_bus_lane_avg_speed": (no_lane, "avg_speed_mph"),
            "bus_lane_segments": (lane, "segment_count"),
            "no_bus_lane_segments": (no_lane, "segment_count"),
        },
    )
    diff = c("bus_lane_avg_speed") - c("no_bus_lane_avg_speed")
    return piv.select(
        "time_period",
        "hour_of_day",
        "bus_lane_avg_speed",
        "no_bus_lane_avg_speed",
        _r2(diff).alias("speed_benefit_mph"),
        round_half(diff / F.nullif(c("no_bus_lane_avg_speed"), F.lit(0.0)) * F.lit(100.0), 1).alias(
            "speed_benefit_pct"
        ),
        "bus_lane_segments",
        "no_bus_lane_segments",
    ).orderBy(c("hour_of_day").asc_nulls_last())


@model("rpt_corridor_summary", layer="table")
def rpt_corridor_summary(w: Warehouse) -> DataFrame:
    cp = w.ref("fct_corridor_performance")
    h = c("hour_of_day").cast("int")
    v = c("corridor_avg_speed_mph")
    agg = cp.groupBy("corridor_street", "borough", "lane_type").agg(
        _r2(F.avg(v)).alias("overall_avg_speed_mph"),
        F.sum("total_trips").alias("total_trips"),
        F.max("segment_count").alias("segment_count"),
        F.max("route_count").alias("route_count"),
        F.count_distinct("metric_date").alias("observation_days"),
        _r2(avg_where(v, h.between(7, 9))).alias("am_peak_avg_speed_mph"),
        _r2(avg_where(v, h.between(16, 19))).alias("pm_peak_avg_speed_mph"),
        _r2(avg_where(v, ~h.between(7, 19))).alias("offpeak_avg_speed_mph"),
    )
    out = agg.withColumn("am_peak_penalty_mph", _r2(c("overall_avg_speed_mph") - c("am_peak_avg_speed_mph")))
    out = out.withColumn("pm_peak_penalty_mph", _r2(c("overall_avg_speed_mph") - c("pm_peak_avg_speed_mph")))
    order = [c("overall_avg_speed_mph").desc_nulls_last()] + [
        c(k).asc_nulls_last() for k in ("corridor_street", "borough", "lane_type")
    ]
    return add_rank(out, order, "speed_rank").orderBy("speed_rank")


EQUITY_QUANTILES = {"p25_speed": 0.25, "median_speed": 0.50, "p75_speed": 0.75, "p90_speed": 0.90}


@model("rpt_equity_analysis", layer="table")
def rpt_equity_analysis(w: Warehouse) -> DataFrame:
    rp = w.ref("fct_route_daily_performance").where(c("borough") != F.lit("Unknown"))
    s = distribution_stats(
        rp, ["borough"], "route_avg_speed_mph", EQUITY_QUANTILES,
        extra=[F.count_distinct("route_id").alias("route_count"), F.sum("total_trips").alias("total_trips")],
    )
    out = s.select(
        "borough",
        _r2(c("_mean")).alias("mean_speed_mph"),
        _r2(c("_stddev")).alias("stddev_speed_mph"),
        _r2(c("p25_speed")).alias("p25_speed_mph"),
        _r2(c("median_speed")).alias("median_speed_mph"),
        _r2(c("p75_speed")).alias("p75_speed_mph"),
        _r2(c("p90_speed")).alias("p90_speed_mph"),
        _r2(c("p75_speed") - c("p25_speed")).alias("iqr_speed_mph"),
        "route_count",
        "total_trips",
        round_half(c("_stddev") / F.nullif(c("_mean"), F.lit(0.0)) * F.lit(100.0), 1).alias("cv_pct"),
    )
    out = add_rank(out, [c("median_speed_mph").desc_nulls_last(), c("borough").asc_nulls_last()],
                   "service_quality_rank")
    out = add_rank(out, [c("cv_pct").asc_nulls_last(), c("borough").asc_nulls_last()], "consistency_rank")
    return out.orderBy("service_quality_rank")


@model("rpt_monthly_trends", layer="table")
def rpt_monthly_trends(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    d = w.ref("dim_date").select("date_day", "year_number", "month_number", "month_name", "year_month_key")
    j = lookup_join(s, d, s["metric_date"] == d["date_day"], "inner", static_rows=CALENDAR_ROWS)
    j = _with_routes(j, w, "borough")
    agg = j.groupBy("year_number", "month_number", "month_name", "year_month_key", "borough").agg(
        _r2(F.avg("avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
        F.count_distinct("route_id").alias("route_count"),
    )
    out = period_over_period(
        agg, ["borough"], [c("year_month_key").asc_nulls_last()], "avg_speed_mph",
        "prior_month_avg_speed", "mom_speed_change_mph", "mom_speed_change_pct",
    )
    return out.orderBy(c("borough").asc_nulls_last(), c("year_month_key").asc_nulls_last())


def _pivot_two(
    df: DataFrame, keys: list[str], cls: str, a: str, b: str, names: dict[str, str]
) -> DataFrame:
    aggregated = df.groupBy(*keys, cls).agg(
        _r2(F.avg("avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
    )
    return pivot_max(
        aggregated,
        keys,
        {
            names["a_avg"]: (c(cls) == F.lit(a), "avg_speed_mph"),
            names["b_avg"]: (c(cls) == F.lit(b), "avg_speed_mph"),
            names["a_trips"]: (c(cls) == F.lit(a), "total_trips"),
            names["b_trips"]: (c(cls) == F.lit(b), "total_trips"),
        },
    )


@model("rpt_peak_vs_offpeak", layer="table")
def rpt_peak_vs_offpeak(w: Warehouse) -> DataFrame:
    s = w.ref("fct_segment_speeds_hourly")
    j = _with_routes(s, w, "route_short_name", "borough")
    j = j.withColumn("period_class", two_class("is_peak_hour", "Peak", "Off-Peak"))
    piv = _pivot_two(
        j, ["route_id", "route_short_name", "borough"], "period_class", "Peak", "Off-Peak",
        {"a_avg": "peak_avg_speed_mph", "b_avg": "offpeak_avg_speed_mph",
         "a_trips": "peak_total_trips", "b_trips": "offpeak_total_trips"},
    )
    out = piv.withColumn("speed_delta_mph", _r2(c("peak_avg_speed_mph") - c("offpeak_avg_speed_mph")))
    return out.orderBy(c("borough").asc_nulls_last(), c("route_short_name").asc_nulls_last())


@model("rpt_route_reliability", layer="table")
def rpt_route_reliability(w: Warehouse) -> DataFrame:
    rp = w.ref("fct_route_daily_performance")
    g = c("reliability_grade")
    agg = rp.groupBy("route_id", "route_short_name", "borough").agg(
        _r2(F.avg("route_avg_speed_mph")).alias("overall_avg_speed_mph"),
        F.sum("total_trips").alias("total_trips"),
        F.count_distinct("metric_date").alias("observation_days"),
        *[count_where(g == F.lit(x)).alias(f"grade_{x.lower()}_days") for x in "ABCDF"],
        F.mode(g, deterministic=True).alias("most_common_grade"),
    )
    order = [c("overall_avg_speed_mph").desc_nulls_last(), c("route_id").asc_nulls_last()]
    out = add_rank(agg, order, "speed_rank")
    out = add_rank(out, order, "reliability_rank")
    return out.orderBy("reliability_rank")


@model("rpt_seasonal_patterns", layer="table")
def rpt_seasonal_patterns(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    d = w.ref("dim_date").select("date_day", "season", "year_number")
    j = lookup_join(s, d, s["metric_date"] == d["date_day"], "inner", static_rows=CALENDAR_ROWS)
    j = _with_routes(j, w, "borough")
    agg = j.groupBy("season", "year_number", "borough").agg(
        _r2(F.avg("avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
        F.count_distinct("route_id").alias("route_count"),
        F.count_distinct("segment_id").alias("segment_count"),
    )
    return agg.orderBy(*[c(k).asc_nulls_last() for k in ("year_number", "season", "borough")])


BOTTLENECK_TOP_N = 50


@model("rpt_speed_bottlenecks", layer="table")
def rpt_speed_bottlenecks(w: Warehouse) -> DataFrame:
    s = w.ref("fct_segment_speeds_hourly")
    agg = s.groupBy("segment_id", "segment_start", "segment_end", "time_period").agg(
        _r2(F.avg("avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
        F.count_distinct("route_id").alias("route_count"),
        F.count_distinct("metric_date").alias("observation_days"),
    )
    order = [c("avg_speed_mph").asc_nulls_last()] + [
        c(k).asc_nulls_last() for k in ("segment_id", "segment_start", "segment_end")
    ]
    top = top_n_per_group(agg, ["time_period"], order, BOTTLENECK_TOP_N, "speed_rank")
    return top.orderBy(c("time_period").asc_nulls_last(), "speed_rank")


@model("rpt_speed_distribution", layer="table")
def rpt_speed_distribution(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    j = _with_routes(s, w, "borough")
    b = j.select(
        "borough",
        bucketize("avg_speed_mph").alias("speed_bucket"),
        bucket_order("avg_speed_mph").alias("bucket_sort_order"),
    )
    dist = share_of_group(b, ["borough"], ["speed_bucket", "bucket_sort_order"], "record_count", "pct_of_borough")
    return dist.orderBy(c("borough").asc_nulls_last(), "bucket_sort_order").select(
        "borough", "speed_bucket", "record_count", "pct_of_borough"
    )


@model("rpt_time_of_day_analysis", layer="table")
def rpt_time_of_day_analysis(w: Warehouse) -> DataFrame:
    s = w.ref("fct_segment_speeds_hourly")
    j = _with_routes(s, w, "borough")
    agg = j.groupBy("hour_of_day", "time_period", "is_peak_hour", "hour_label", "borough").agg(
        _r2(F.avg("avg_speed_mph")).alias("avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
        F.count_distinct("route_id").alias("route_count"),
        F.count_distinct("segment_id").alias("segment_count"),
    )
    return agg.orderBy(c("hour_of_day").cast("int").asc_nulls_last(), c("borough").asc_nulls_last())


@model("rpt_weekend_vs_weekday", layer="table")
def rpt_weekend_vs_weekday(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    d = w.ref("dim_date").select("date_day", "is_weekend")
    j = lookup_join(s, d, s["metric_date"] == d["date_day"], "left", static_rows=CALENDAR_ROWS)
    j = _with_routes(j, w, "route_short_name", "borough")
    j = j.withColumn("day_type", two_class("is_weekend", "Weekend", "Weekday"))
    piv = _pivot_two(
        j, ["route_id", "route_short_name", "borough"], "day_type", "Weekday", "Weekend",
        {"a_avg": "weekday_avg_speed_mph", "b_avg": "weekend_avg_speed_mph",
         "a_trips": "weekday_total_trips", "b_trips": "weekend_total_trips"},
    )
    out = piv.withColumn("weekend_speed_delta_mph", _r2(c("weekend_avg_speed_mph") - c("weekday_avg_speed_mph")))
    return out.orderBy(c("borough").asc_nulls_last(), c("route_short_name").asc_nulls_last())
