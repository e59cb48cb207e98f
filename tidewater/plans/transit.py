"""Transit models: staging, intermediate, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import (
    grade,
    md5_or_null,
    prefix_category,
    surrogate_key,
    try_cast_double,
    try_cast_int,
    try_cast_long,
)
from tidewater.operators import (
    dedup_latest,
    first_containment_match,
    keep_unmatched,
    lookup_join,
    sums_and_distincts,
    with_group_total,
)
from tidewater.plans.calendar import CALENDAR_ROWS
from tidewater.plans.core import Warehouse, model
from tidewater.session import checkpoint_dir
from tidewater.sources.files import stack

c = F.col

# ----------------------------------------------------------------- staging


def _text_or_null(src: DataFrame, name: str):
    """A column some feed layouts do not deliver: NULL text when absent."""
    return c(name) if name in src.columns else F.lit(None).cast("string").alias(name)


def _segment():
    return F.concat(c("timepoint_stop_id"), F.lit("-"), c("next_timepoint_stop_id"))


def stage_speeds(src: DataFrame, data_source: str) -> DataFrame:
    """Raw segment speeds (all text) -> typed rows with the segment key.

    Rows travel to the dedup with the key's 16 bytes; texts made of other
    columns (the key as hex digits, the segment) are written after it.
    """
    opt = {n: _text_or_null(src, n) for n in (
        "timepoint_stop_latitude", "timepoint_stop_longitude",
        "next_timepoint_stop_latitude", "next_timepoint_stop_longitude")}
    return src.select(
        F.unhex(surrogate_key("route_id", _segment(), "year", "month", "day_of_week", "hour_of_day")).alias("_key"),
        "route_id",
        "timepoint_stop_id",
        c("timepoint_stop_name").alias("segment_start"),
        opt["timepoint_stop_latitude"],
        opt["timepoint_stop_longitude"],
        "next_timepoint_stop_id",
        c("next_timepoint_stop_name").alias("segment_end"),
        opt["next_timepoint_stop_latitude"],
        opt["next_timepoint_stop_longitude"],
        "direction",
        "borough",
        "route_type",
        "stop_order",
        "year",
        "month",
        "day_of_week",
        "hour_of_day",
        try_cast_double("road_distance").alias("road_distance_miles"),
        try_cast_double("average_travel_time").alias("avg_travel_time_min"),
        try_cast_double("average_road_speed").alias("avg_speed_mph"),
        try_cast_int("bus_trip_count").alias("trip_count"),
        "timestamp",
        F.lit(data_source).alias("data_source"),
        "_dlt_id",
    )


def latest_per_key(staged: DataFrame) -> DataFrame:
    latest = dedup_latest(staged, ["_key"], [c("timestamp").desc_nulls_last(), c("_dlt_id").asc()])
    rest = [x for x in staged.columns if x not in ("_key", "route_id", "_dlt_id")]
    return latest.select(
        F.lower(F.hex("_key")).alias("segment_speed_id"), "route_id", _segment().alias("segment_id"), *rest)


@model("stg_bus_segment_speeds")
def stg_bus_segment_speeds(w: Warehouse) -> DataFrame:
    return latest_per_key(stage_speeds(w.raw("bus_segment_speeds_2025"), "2025"))


@model("stg_bus_segment_speeds_all_years")
def stg_bus_segment_speeds_all_years(w: Warehouse) -> DataFrame:
    """The 2023-2024 dataset stacked onto 2025 (SET-2), then one row per key.

    The union keeps every row of both datasets; the latest observation per
    segment key wins across datasets.
    """
    stacked = stack(
        stage_speeds(w.raw("bus_segment_speeds_2025"), "2025"),
        stage_speeds(w.raw("bus_segment_speeds_2023_2024"), "2023-2024"),
    )
    return latest_per_key(stacked)


@model("stg_bus_routes")
def stg_bus_routes(w: Warehouse) -> DataFrame:
    src = w.raw("gtfs_routes").where(c("route_id").isNotNull())
    typed = src.select(
        c("route_id").cast("string").alias("route_id"),
        c("route_short_name").cast("string").alias("route_short_name"),
        c("route_long_name").cast("string").alias("route_long_name"),
        c("route_type").cast("int").alias("route_type"),
        c("route_color").cast("string").alias("route_color"),
        c("route_text_color").cast("string").alias("route_text_color"),
    )
    order = [c(x).asc_nulls_last() for x in typed.columns[1:]]
    return dedup_latest(typed, ["route_id"], order)


@model("stg_bus_stops")
def stg_bus_stops(w: Warehouse) -> DataFrame:
    src = w.raw("gtfs_stops").where(c("stop_id").isNotNull())
    return src.select(
        c("stop_id").cast("string").alias("stop_id"),
        c("stop_name").cast("string").alias("stop_name"),
        c("stop_lat").cast("double").alias("stop_lat"),
        c("stop_lon").cast("double").alias("stop_lon"),
    )


# Feed column -> staged column.
LANE_TEXT_COLUMNS = [
    ("street", "street"), ("segmentid", "segment_id"), ("boro", "borough"), ("facility", "facility"),
    ("direction", "direction"), ("hours", "hours"), ("days", "days"), ("lane_type", "lane_type"),
    ("lane_type1", "lane_type1"), ("lane_type2", "lane_type2"), ("open_dates", "open_dates"),
    ("lane_width", "lane_width"), ("lane_color", "lane_color"), ("sbs_route1", "sbs_route1"),
    ("sbs_route2", "sbs_route2"), ("bltrafdir", "bltrafdir"), ("rw_type", "rw_type"),
    ("streetwidt", "street_width"),
]


@model("stg_bus_lanes")
def stg_bus_lanes(w: Warehouse) -> DataFrame:
    src = w.raw("bus_lanes").where(c("street").isNotNull())
    return src.select(
        *[c(a).cast("string").alias(b) for a, b in LANE_TEXT_COLUMNS],
        try_cast_double("shape_leng").alias("shape_length"),
    )


@model("stg_traffic_volume_counts")
def stg_traffic_volume_counts(w: Warehouse) -> DataFrame:
    src = w.raw("traffic_volume_counts").where(
        c("segmentid").isNotNull() & c("yr").isNotNull() & c("m").isNotNull() & c("d").isNotNull()
    )
    return src.select(
        c("segmentid").cast("string").alias("segment_id"),
        c("requestid").cast("string").alias("request_id"),
        c("street").cast("string").alias("street"),
        c("fromst").cast("string").alias("from_street"),
        c("tost").cast("string").alias("to_street"),
        c("direction").cast("string").alias("direction"),
        c("boro").cast("string").alias("borough"),
        c("wktgeom").cast("string").alias("wkt_geom"),
        F.make_date(try_cast_int("yr"), try_cast_int("m"), try_cast_int("d")).alias("date"),
        try_cast_int("hh").alias("hour"),
        try_cast_int("mm").alias("minute"),
        try_cast_long("vol").alias("volume"),
    )


# ------------------------------------------------------------ intermediate


def dated(w: Warehouse, rows: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``metric_date``: the first day of the calendar with their year, month and weekday."""
    firsts = (
        w.ref("dim_date")
        .groupBy("year_number", "month_number", "day_of_week_name")
        .agg(F.min("date_day").alias("metric_date"))
    )
    cond = (
        (rows["year"].cast("int") == firsts["year_number"])
        & (rows["month"].cast("int") == firsts["month_number"])
        & (rows["day_of_week"] == firsts["day_of_week_name"])
    )
    return lookup_join(rows, firsts, cond, how, static_rows=CALENDAR_ROWS)


@model("int_representative_dates")
def int_representative_dates(w: Warehouse) -> DataFrame:
    combos = w.ref("stg_bus_segment_speeds").select("year", "month", "day_of_week").distinct()
    return dated(w, combos, "inner").select("year", "month", "day_of_week", "metric_date")


LANE_ORDER = ["lane_segment_id", "lane_borough", "lane_type"]


@model("int_segment_bus_lane_match")
def int_segment_bus_lane_match(w: Warehouse) -> DataFrame:
    # Distinct segment x route names: small (stop pairs x routes), reused by
    # every branch below -> computed once and checkpointed to the shared
    # checkpoint folder (lineage cut; survives executor loss).
    checkpoint_dir(w.spark)
    segments = (
        w.ref("stg_bus_segment_speeds")
        .select("segment_id", "route_id", "segment_start", "segment_end")
        .distinct()
        .checkpoint(eager=True)
    )
    lanes = w.ref("stg_bus_lanes").select(
        c("street").alias("lane_street"),
        c("segment_id").alias("lane_segment_id"),
        c("borough").alias("lane_borough"),
        "lane_type",
    )
    matched = first_containment_match(
        segments,
        keys=["segment_id", "route_id"],
        name_cols=["segment_start", "segment_end"],
        targets=lanes,
        target_col="lane_street",
        target_order=LANE_ORDER,
    ).select("segment_id", "route_id", "lane_street", "lane_borough", "lane_type", F.lit(True).alias("has_bus_lane"))
    out = keep_unmatched(segments, matched, ["segment_id", "route_id"], "has_bus_lane", False)
    return out.select(
        "segment_id", "route_id", "segment_start", "segment_end",
        "lane_street", "lane_borough", "lane_type", "has_bus_lane",
    )


@model("int_traffic_volume_hourly")
def int_traffic_volume_hourly(w: Warehouse) -> DataFrame:
    hourly = (
        w.ref("stg_traffic_volume_counts")
        .where(c("volume").isNotNull())
        .select(
            "segment_id", "street", "from_street", "to_street", "direction", "date",
            c("hour").alias("hour_of_day"), c("volume").alias("hourly_volume"),
        )
    )
    return with_group_total(hourly, ["segment_id", "street", "direction", "date"], "hourly_volume", "daily_volume")


# -------------------------------------------------------------- dimensions


@model("dim_bus_lanes", layer="table")
def dim_bus_lanes(w: Warehouse) -> DataFrame:
    cols = ["street", "segment_id", "borough", "lane_type", "facility", "direction", "hours", "days",
            "lane_type1", "lane_type2", "open_dates", "sbs_route1", "sbs_route2"]
    lanes = w.ref("stg_bus_lanes").select(*cols)
    order = [c(x).asc_nulls_last() for x in cols[3:]]
    first = dedup_latest(lanes, ["street", "segment_id", "borough"], order)
    return first.select(surrogate_key("street", "segment_id", "borough").alias("bus_lane_key"), *cols)


@model("dim_bus_segments", layer="table")
def dim_bus_segments(w: Warehouse) -> DataFrame:
    segs = w.ref("stg_bus_segment_speeds").select("segment_id", "segment_start", "segment_end", "route_id").distinct()
    keyed = segs.select(
        surrogate_key("segment_id", "route_id").alias("segment_key"),
        "segment_id", "route_id", "segment_start", "segment_end",
    )
    order = [c("route_id").asc_nulls_last(), c("segment_start").asc_nulls_last(), c("segment_end").asc_nulls_last()]
    return dedup_latest(keyed, ["segment_id"], order)


@model("dim_bus_routes", layer="table")
def dim_bus_routes(w: Warehouse) -> DataFrame:
    r = w.ref("stg_bus_routes")
    return r.select(
        md5_or_null("route_id").alias("route_key"),
        "route_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color",
        prefix_category("route_id").alias("borough"),
    )


@model("dim_bus_stops", layer="table")
def dim_bus_stops(w: Warehouse) -> DataFrame:
    s = w.ref("stg_bus_stops")
    return s.select(md5_or_null("stop_id").alias("stop_key"), "stop_id", "stop_name", "stop_lat", "stop_lon")


# ------------------------------------------------------------------- facts


@model("fct_bus_segment_speeds", layer="table")
def fct_bus_segment_speeds(w: Warehouse) -> DataFrame:
    # The date follows from the calendar alone, at most one for each (year, month, weekday):
    # joining int_representative_dates would stage all rows a second time to find the same.
    return dated(w, w.ref("stg_bus_segment_speeds"), "left").select(
        surrogate_key("route_id", "segment_id", "metric_date", "hour_of_day").alias("segment_speed_key"),
        "route_id", "segment_id", "metric_date", "year", "month", "day_of_week", "hour_of_day", "data_source",
        "avg_speed_mph", "trip_count", "road_distance_miles", "avg_travel_time_min",
        "segment_start", "segment_end", "direction", "borough", "route_type",
    )


@model("fct_segment_speeds_hourly", layer="table")
def fct_segment_speeds_hourly(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    t = w.ref("dim_time_of_day").select(
        c("hour_of_day").alias("_h"), "time_period", "time_period_sort_order", "is_peak_hour", "hour_label"
    )
    j = lookup_join(s, t, s["hour_of_day"].cast("long") == t["_h"], "left", static_rows=24)
    return j.select(
        "segment_speed_key", "route_id", "segment_id", "metric_date", "year", "month", "day_of_week", "hour_of_day",
        "time_period", "time_period_sort_order", "is_peak_hour", "hour_label",
        "avg_speed_mph", "trip_count", "road_distance_miles", "avg_travel_time_min",
        "segment_start", "segment_end", "direction", "borough", "route_type", "data_source",
    )


@model("fct_route_daily_performance", layer="table")
def fct_route_daily_performance(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    agg = s.groupBy("route_id", "metric_date", "year", "month", "day_of_week").agg(
        F.avg("avg_speed_mph").alias("route_avg_speed_mph"),
        F.sum("trip_count").cast("long").alias("total_trips"),
        F.count_distinct("segment_id").alias("segment_count"),
    )
    graded = agg.select(
        surrogate_key("route_id", "metric_date").alias("route_daily_key"),
        "route_id", "metric_date", "year", "month", "day_of_week",
        "route_avg_speed_mph", "total_trips", "segment_count",
        grade("route_avg_speed_mph").alias("reliability_grade"),
    )
    routes = w.ref("dim_bus_routes").select("route_id", "route_short_name", "borough")
    return lookup_join(graded, routes, "route_id", "left")


@model("fct_corridor_performance", layer="table")
def fct_corridor_performance(w: Warehouse) -> DataFrame:
    s = w.ref("fct_bus_segment_speeds")
    # The lane match has one row per segment x route but is joined on the
    # segment only, so every fact row counts once per matching route (the
    # reference's grain quirk, kept).  Instead of materialising that fan-out,
    # the match is collapsed to (segment, lane attributes) with the number of
    # rows it stands for, and the averages / sums are weighted by it.
    lm = (
        w.ref("int_segment_bus_lane_match")
        .where(c("has_bus_lane") == F.lit(True))
        .groupBy("segment_id", "lane_street", "lane_borough", "lane_type", "has_bus_lane")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    j = s.select("metric_date", "year", "month", "day_of_week", "hour_of_day", "segment_id", "route_id",
                 "avg_speed_mph", "trip_count").join(lm, "segment_id", "inner")
    keys = ["metric_date", "year", "month", "day_of_week", "hour_of_day"]
    lanes = {"lane_street": "corridor_street", "lane_borough": "borough"}
    group = [*keys, *lanes.values(), "lane_type", "has_bus_lane"]
    told = c("avg_speed_mph").isNotNull()
    agg = sums_and_distincts(
        j.withColumnsRenamed(lanes), group,
        {"_speed": c("avg_speed_mph") * c("_w"), "_n": F.when(told, c("_w")), "total_trips": c("trip_count") * c("_w")},
        {"segment_count": "segment_id", "route_count": "route_id"},
    ).select(
        *group, (c("_speed") / c("_n")).alias("corridor_avg_speed_mph"), c("total_trips").cast("long").alias("total_trips"),
        "segment_count", "route_count",
    )
    key = surrogate_key("metric_date", "corridor_street", "hour_of_day").alias("corridor_performance_key")
    return agg.select(key, *agg.columns)


@model("fct_traffic_volume_patterns", layer="table")
def fct_traffic_volume_patterns(w: Warehouse) -> DataFrame:
    h = w.ref("int_traffic_volume_hourly")
    t = w.ref("dim_time_of_day").select(c("hour_of_day").alias("_h"), "time_period")
    j = lookup_join(h, t, h["hour_of_day"].cast("long") == t["_h"], "inner", static_rows=24)
    agg = j.groupBy(
        "segment_id", "street", "from_street", "to_street", "direction", "date", "time_period", "daily_volume"
    ).agg(
        F.sum("hourly_volume").alias("period_volume"),
        F.avg("hourly_volume").alias("avg_hourly_volume"),
    )
    out = agg.select(
        "segment_id", "street", "from_street", "to_street", "direction", "date", "time_period",
        "period_volume", "avg_hourly_volume", "daily_volume",
    )
    key = surrogate_key("segment_id", "street", "date", "time_period", "direction").alias("traffic_volume_key")
    return out.select(key, *out.columns)


@model("sem_bus_segment_speeds", layer="table")
def sem_bus_segment_speeds(w: Warehouse) -> DataFrame:
    return w.ref("fct_bus_segment_speeds").select(
        "segment_speed_key", "route_id", "segment_id", "metric_date", "hour_of_day", "avg_speed_mph",
        "trip_count", "road_distance_miles", "avg_travel_time_min", "segment_start", "segment_end",
    )
