"""Operator-level queries beyond the model catalogue: the metric layer,
declared data-quality checks, profiling and source status.

Each entry reads the driver tables (through the models) in full; each has an
independent DuckDB oracle built on the same SQL blocks as the models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.metrics import Measure, MetricsView, SemanticModel, auto_metrics, densify
from tidewater.ops import auto_stage, freshness_label, last_sync, profile, table_counts
from tidewater.quality import ModelChecks, oracle_sql as dq_oracle_sql, run_checks
from tidewater.sources.adapters import RAW_TABLES
from tidewater.verify.oracle import with_blocks

# --- metric views (fixed definitions) ----------------------------------------
# Column names follow the models; measures the models cannot support
# (speed variability) are left out.


def speeds_view(w) -> MetricsView:
    return MetricsView(
        w.ref("fct_bus_segment_speeds"), "metric_date", ["route_id", "segment_id", "hour_of_day"],
        [Measure("avg(avg_speed_mph)", "Avg Speed (mph)"), Measure("sum(trip_count)", "Total Trips"),
         Measure("count(*)", "Records")],
    )


# Averages of averages are rounded to six decimals, a little off the half-way points: sums of
# doubles differ in the last bit with the order of addition, which must not decide a digit.


def corridor_view(w) -> MetricsView:
    return MetricsView(
        w.ref("fct_corridor_performance"), "metric_date", ["corridor_street", "has_bus_lane"],
        [Measure("round(avg(corridor_avg_speed_mph) * 1e6 + 1e-4) / 1e6", "Avg Speed (mph)"),
         Measure("round(avg(corridor_avg_speed_mph) filter (where has_bus_lane = true) * 1e6 + 1e-4) / 1e6",
                 "Avg Speed With Bus Lane (mph)"),
         Measure("round(avg(corridor_avg_speed_mph) filter (where has_bus_lane = false) * 1e6 + 1e-4) / 1e6",
                 "Avg Speed Without Bus Lane (mph)"),
         Measure("count(*)", "Records")],
    )


def route_view(w) -> MetricsView:
    grades = [Measure(f"countif(reliability_grade = '{g}')", f"Grade {g} Count") for g in "ABCDF"]
    return MetricsView(
        w.ref("fct_route_daily_performance"), "metric_date", ["route_id", "reliability_grade"],
        [Measure("round(avg(route_avg_speed_mph) * 1e6 + 1e-4) / 1e6", "Avg Speed (mph)"), Measure("count(*)", "Records"), *grades],
    )


def traffic_view(w) -> MetricsView:
    return MetricsView(
        w.ref("fct_traffic_volume_patterns"), "date", ["segment_id", "time_period"],
        [Measure("sum(period_volume)", "Total Volume"), Measure("avg(avg_hourly_volume)", "Avg Volume"),
         Measure("count(*)", "Records")],
    )


def speeds_semantic(w) -> SemanticModel:
    return SemanticModel(
        w.ref("sem_bus_segment_speeds"), "metric_date",
        {"avg_bus_speed": ("average", "avg_speed_mph"), "total_bus_trips": ("sum", "trip_count"),
         "avg_segment_travel_time": ("average", "avg_travel_time_min"),
         "total_road_distance_miles": ("sum", "road_distance_miles")},
        dimensions=["route_id", "segment_id", "hour_of_day", "segment_start", "segment_end"],
        entities={"segment_speed": "segment_speed_key", "route": "route_id", "segment": "segment_id"},
    )


# --- fixed values: declared checks of the models ---------------------------------
# model: not-null columns; a star marks those that are unique as well.
NOT_NULL_AND_UNIQUE = {
    "transit": """
        int_representative_dates: year month day_of_week metric_date
        int_segment_bus_lane_match: segment_id route_id has_bus_lane
        int_traffic_volume_hourly: segment_id date hour_of_day hourly_volume daily_volume
        dim_bus_routes: route_key* route_id* route_short_name borough
        dim_bus_stops: stop_key* stop_id* stop_name stop_lat stop_lon
        dim_bus_segments: segment_key* segment_id* route_id
        dim_bus_lanes: bus_lane_key* street borough
        dim_date: date_day* date_key* year_number quarter_number month_number month_name day_of_week_number day_of_week_name is_weekend season fiscal_year
        dim_time_of_day: hour_of_day* time_period is_peak_hour hour_label
        fct_bus_segment_speeds: segment_speed_key* route_id segment_id avg_speed_mph
        fct_route_daily_performance: route_daily_key* route_id reliability_grade route_avg_speed_mph
        fct_corridor_performance: corridor_performance_key* corridor_street has_bus_lane corridor_avg_speed_mph
        fct_traffic_volume_patterns: traffic_volume_key* segment_id date time_period period_volume
        fct_segment_speeds_hourly: segment_speed_key* route_id hour_of_day time_period avg_speed_mph
        metricflow_time_spine: date_day*
        sem_bus_segment_speeds: segment_speed_key* route_id segment_id metric_date hour_of_day avg_speed_mph
        stg_bus_routes: route_id* route_short_name
        stg_bus_stops: stop_id* stop_name stop_lat stop_lon
        stg_bus_segment_speeds: segment_speed_id* route_id segment_id year month day_of_week hour_of_day avg_speed_mph data_source
        stg_bus_lanes: street borough
        stg_traffic_volume_counts: segment_id date volume
    """,
    "reports": """
        rpt_speed_bottlenecks: segment_id time_period avg_speed_mph speed_rank
        rpt_bus_lane_effectiveness: time_period hour_of_day
        rpt_route_reliability: route_id* most_common_grade overall_avg_speed_mph reliability_rank
        rpt_seasonal_patterns: season year_number avg_speed_mph
        rpt_peak_vs_offpeak: route_id*
        rpt_borough_comparison: borough* avg_speed_mph speed_rank
        rpt_equity_analysis: borough* median_speed_mph cv_pct
        rpt_corridor_summary: corridor_street overall_avg_speed_mph speed_rank
        rpt_time_of_day_analysis: hour_of_day time_period avg_speed_mph
        rpt_weekend_vs_weekday: route_id*
        rpt_speed_distribution: speed_bucket record_count pct_of_borough
        rpt_monthly_trends: year_number month_number avg_speed_mph
    """,
    "saas": """
        github_issues: issue_id* id* number title state is_open is_pull_request created_at
        github_pull_requests: pull_request_id* id* number title state is_merged is_draft created_at
        github_repo_activity: activity_date*
        notion_pages: page_id* page_url parent_type created_by_id last_edited_by_id created_time last_edited_time archived
        notion_workspace_activity: activity_date* pages_edited pages_created unique_editors cumulative_pages_created
        slack_channel_activity: channel_activity_key* channel_id channel_name is_private is_active activity_date message_count unique_users thread_replies threads_started messages_with_reactions
        slack_user_activity: user_activity_key* user_id username is_bot is_active activity_week messages_sent channels_active_in threads_started thread_replies_sent messages_with_reactions
        stg_github_issues: issue_id* id* number title state is_open is_pull_request created_at
        stg_github_pull_requests: pull_request_id* id* number title state is_merged is_draft created_at
        stg_github_commits: commit_id* sha* committed_at
        stg_notion_users: id* type is_person
        stg_notion_databases: id* url created_time last_edited_time created_by_id last_edited_by_id
        stg_notion_pages: id* url created_time last_edited_time created_by_id last_edited_by_id parent_type archived
        stg_slack_channels: channel_id* channel_name is_private is_archived is_active
        stg_slack_users: user_id* username is_bot is_admin is_owner is_deleted is_active
        stg_slack_messages: message_ts channel_id is_thread_reply is_thread_root has_reactions is_user_message
    """,
}
ACCEPTED = {
    "dim_bus_routes": {"borough": ["Queens", "Bronx", "Brooklyn", "Manhattan", "Staten Island", "Unknown"]},
    "fct_route_daily_performance": {"reliability_grade": ["A", "B", "C", "D", "F"]},
    "dim_date": {"season": ["Winter", "Spring", "Summer", "Fall"]},
    "dim_time_of_day": {"time_period": ["AM Peak", "Midday", "PM Peak", "Evening", "Overnight"]},
    "github_issues": {"state": ["open", "closed"]},
    "github_pull_requests": {"state": ["open", "closed"]},
    "stg_github_issues": {"state": ["open", "closed"]},
    "stg_github_pull_requests": {"state": ["open", "closed"]},
    "stg_bus_segment_speeds": {"data_source": ["2025"]},
    "stg_notion_users": {"type": ["person", "bot"]},
}
# -----------------------------------------------------------------------------


def declared_checks(area: str) -> list[ModelChecks]:
    specs = []
    for line in NOT_NULL_AND_UNIQUE[area].split("\n"):
        if line.strip():
            model, columns = line.strip().split(": ")
            names = columns.split()
            specs.append(ModelChecks(
                model, not_null=[n.rstrip("*") for n in names], unique=[n[:-1] for n in names if n.endswith("*")],
                accepted=ACCEPTED.get(model, {}),
            ))
    return specs


CHECKS = {area: declared_checks(area) for area in NOT_NULL_AND_UNIQUE}

# --- sources and their freshness column ----------------------------------------
SOURCES = {
    "mta_bus_speeds": ["bus_segment_speeds_2025", "bus_segment_speeds_2023_2024"],
    "mta": ["gtfs_routes", "gtfs_stops"],
    "nyc_dot": ["bus_lanes", "traffic_volume_counts"],
    "github": ["github.commits", "github.issues", "github.pull_requests"],
    "slack": ["slack.messages", "slack.channels", "slack.users"],
    "notion": ["notion.pages", "notion.databases", "notion.users"],
}
# The load audit of the driver tables: (source, status, inserted_at); status 0 is a finished load.
LOADS = [
    ("mta_bus_speeds", 0, "2024-01-31 23:30:00"), ("mta_bus_speeds", 0, "2024-01-30 08:00:00"), ("mta_bus_speeds", 1, "2024-01-31 23:59:00"),
    ("mta", 0, "2024-01-31 12:10:00"), ("mta", 0, "2024-01-20 00:00:00"), ("mta", 1, "2024-01-31 13:00:00"),
    ("nyc_dot", 0, "2024-01-28 06:00:00"), ("nyc_dot", 0, "2024-01-27 06:00:00"), ("nyc_dot", 1, "2024-01-29 06:00:00"),
    ("github", 0, "2024-01-12 00:00:00"), ("github", 0, "2024-01-10 00:00:00"), ("github", 1, "2024-01-30 00:00:00"),
    ("slack", 0, "2024-01-31 00:00:00"), ("slack", 0, "2024-01-30 00:00:00"), ("slack", 1, "2024-01-31 10:00:00"),
    ("notion", 1, "2024-01-31 22:00:00"), ("notion", 1, "2024-01-30 22:00:00"), ("notion", 1, "2024-01-29 22:00:00"),
]
RAW_BLOCK = {
    "bus_segment_speeds_2025": "raw_speeds", "bus_segment_speeds_2023_2024": "raw_speeds_2023_2024",
    "gtfs_routes": "raw_routes", "gtfs_stops": "raw_stops",
    "bus_lanes": "raw_lanes", "traffic_volume_counts": "raw_traffic", "github.commits": "raw_commits",
    "github.issues": "raw_issues", "github.pull_requests": "raw_pulls", "slack.messages": "raw_messages",
    "slack.channels": "raw_channels", "slack.users": "raw_slack_users", "notion.pages": "raw_pages",
    "notion.databases": "raw_databases", "notion.users": "raw_notion_users",
}
STATUS_AS_OF = "2024-02-01 00:00:00"
# -----------------------------------------------------------------------------


def q_metric_speeds_by_route_day(w) -> DataFrame:
    return speeds_view(w).query(dimensions=["route_id"], grain="day")


def q_metric_route_grades_by_month(w):
    return route_view(w).query(dimensions=["reliability_grade"], grain="month")


def q_metric_corridor_by_week(w):
    return corridor_view(w).query(dimensions=["corridor_street"], grain="week")


def q_metric_traffic_last_3_months(w):
    return traffic_view(w).query(dimensions=["time_period"], grain="month", time_range="P3M")


def q_metric_avg_speed_densified(w):
    return densify(speeds_semantic(w).metric("avg_bus_speed", grain="day"), w.ref("metricflow_time_spine"))


def q_auto_metrics_segment_speeds(w):
    return auto_metrics(w.ref("fct_bus_segment_speeds")).query(dimensions=[], grain="month")


def _checked(w, area: str) -> DataFrame:
    """The area's checks over written tables: every checked model is built once, then scanned."""
    specs = CHECKS[area]
    w.materialize |= {c.model for c in specs}
    return run_checks(w.ref, specs)


def q_dq_transit(w):
    return _checked(w, "transit")


def q_dq_reports(w):
    w.materialize |= {c.model for c in CHECKS["transit"]}  # what the reports read
    return _checked(w, "reports")


def q_dq_saas(w):
    return _checked(w, "saas")


def q_raw_table_counts(w):
    return table_counts({name: (lambda n=name: w.raw(n)) for name in RAW_TABLES})


def q_source_status(w):
    """Rows of every source's raw tables and its last finished load of the audit."""
    parts = [
        w.raw(t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(src).alias("source"), "rows")
        for src, tables in SOURCES.items() for t in tables
    ]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    counts = counts.groupBy("source").agg(F.count("rows").alias("table_count"), F.sum("rows").alias("total_rows"))
    loads = w.spark.createDataFrame(LOADS, "schema_name string, status int, at string").select(
        "schema_name", "status", F.col("at").cast("timestamp_ntz").alias("inserted_at"))
    synced = last_sync(loads).withColumnRenamed("schema_name", "source")
    agg = counts.join(synced, "source", "left")
    label, colour = freshness_label(F.col("last_sync"), F.lit(STATUS_AS_OF).cast("timestamp_ntz"))
    return agg.select("source", "table_count", "total_rows", "last_sync",
                      label.alias("freshness"), colour.alias("freshness_color"))


def q_profile_orders(w):
    return profile(w.raw.tables("orders"))


def q_auto_stage_commits(w):
    return auto_stage(w.raw("github.commits"))


def q_alias_customers(w):
    return w.raw.tables("customer")


# Queries over a built warehouse (the bench runs them after the build).
WAREHOUSE_QUERIES = {
    "metric_speeds_by_route_day": q_metric_speeds_by_route_day,
    "metric_route_grades_by_month": q_metric_route_grades_by_month,
    "metric_corridor_by_week": q_metric_corridor_by_week,
    "metric_traffic_last_3_months": q_metric_traffic_last_3_months,
    "metric_avg_speed_densified": q_metric_avg_speed_densified,
    "auto_metrics_segment_speeds": q_auto_metrics_segment_speeds,
    "dq_transit": q_dq_transit,
    "dq_reports": q_dq_reports,
    "dq_saas": q_dq_saas,
    "raw_table_counts": q_raw_table_counts,
    "source_status": q_source_status,
    "profile_orders": q_profile_orders,
    "auto_stage_commits": q_auto_stage_commits,
    "alias_customers": q_alias_customers,
}


def _bind(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.registry import warehouse

        return fn(warehouse(spark, sf_dir))

    run.__name__ = fn.__name__
    return run


def queries() -> dict:
    return {name: _bind(fn) for name, fn in WAREHOUSE_QUERIES.items()}


# ------------------------------------------------------------------ oracles


def _profile_sql() -> str:
    cols = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
    parts = []
    for c, t in cols:
        parts.append(
            f"select '{c}' as column_name, '{t}' as data_type, count(*) filter (where {c} is null) as null_count, "
            f"count(distinct {c}) as distinct_count, cast(min({c}) as varchar) as min_value, "
            f"cast(max({c}) as varchar) as max_value from orders")
    return "\nunion all\n".join(parts)


def _status_sql() -> str:
    rows = [f"select '{src}' as source, count(*) as n from {RAW_BLOCK[t]}" for src, tables in SOURCES.items() for t in tables]
    deps = [RAW_BLOCK[t] for tables in SOURCES.values() for t in tables]
    body = "\nunion all\n".join(rows)
    audit = ", ".join(f"('{a}', {b}, timestamp '{c}')" for a, b, c in LOADS)
    age = f"(epoch(timestamp '{STATUS_AS_OF}') - epoch(last_sync))"
    final = f"""
select source, table_count, total_rows, last_sync,
  case when last_sync is null then 'never'
       when {age} / 3600.0 < 1 then cast(floor({age} / 60) as bigint)::varchar || 'm ago'
       when {age} / 3600.0 < 24 then cast(floor({age} / 3600.0) as bigint)::varchar || 'h ago'
       else cast(floor({age} / 3600.0 / 24.0) as bigint)::varchar || 'd ago' end as freshness,
  case when last_sync is null then 'red' when {age} / 3600.0 < 24 then 'green'
       when {age} / 3600.0 < 168 then 'yellow' else 'red' end as freshness_color
from (select r.source, count(*) as table_count, cast(sum(n) as bigint) as total_rows,
        any_value((select max(a.loaded) from (values {audit}) a(source, status, loaded) where a.source = r.source and a.status = 0)) as last_sync
      from ({body}) r group by r.source)"""
    return with_blocks(deps, final)


def oracles() -> dict:
    speeds = with_blocks(["fct_bus_segment_speeds"], """
select cast(date_trunc('day', metric_date) as date) as period, route_id, avg(avg_speed_mph) as avg_speed_mph,
  cast(sum(trip_count) as bigint) as total_trips, count(*) as records
from fct_bus_segment_speeds group by all""")
    grades = ", ".join(
        f"cast(count_if(reliability_grade = '{g}') as bigint) as grade_{g.lower()}_count" for g in "ABCDF")
    routes = with_blocks(["fct_route_daily_performance"], f"""
select cast(date_trunc('month', metric_date) as date) as period, reliability_grade,
  round(avg(route_avg_speed_mph) * 1e6 + 1e-4) / 1e6 as avg_speed_mph, count(*) as records, {grades}
from fct_route_daily_performance group by all""")
    corridor = with_blocks(["fct_corridor_performance"], """
select cast(date_trunc('week', metric_date) as date) as period, corridor_street,
  round(avg(corridor_avg_speed_mph) * 1e6 + 1e-4) / 1e6 as avg_speed_mph,
  round(avg(corridor_avg_speed_mph) filter (where has_bus_lane = true) * 1e6 + 1e-4) / 1e6 as avg_speed_with_bus_lane_mph,
  round(avg(corridor_avg_speed_mph) filter (where has_bus_lane = false) * 1e6 + 1e-4) / 1e6 as avg_speed_without_bus_lane_mph,
  count(*) as records
from fct_corridor_performance group by all""")
    traffic = with_blocks(["fct_traffic_volume_patterns"], """
select cast(date_trunc('month', "date") as date) as period, time_period,
  cast(sum(period_volume) as bigint) as total_volume, avg(avg_hourly_volume) as avg_volume, count(*) as records
from fct_traffic_volume_patterns
where "date" >= (select max("date") from fct_traffic_volume_patterns) - interval 3 month
group by all""")
    densified = with_blocks(["metricflow_time_spine", "sem_bus_segment_speeds"], """
select s.date_day, m.avg_bus_speed from metricflow_time_spine s
left join (select cast(date_trunc('day', metric_date) as date) as date_day, avg(avg_speed_mph) as avg_bus_speed
           from sem_bus_segment_speeds group by 1) m on s.date_day = m.date_day""")
    auto = with_blocks(["fct_bus_segment_speeds"], """
select cast(date_trunc('month', metric_date) as date) as period, count(*) as record_count,
  avg(avg_speed_mph) as avg_avg_speed_mph, cast(sum(trip_count) as bigint) as sum_trip_count,
  avg(road_distance_miles) as avg_road_distance_miles, avg(avg_travel_time_min) as avg_avg_travel_time_min
from fct_bus_segment_speeds group by all""")
    counts = with_blocks(list(RAW_BLOCK.values()), "\nunion all\n".join(
        f"select '{t}' as table_name, count(*) as row_count from {b}" for t, b in RAW_BLOCK.items()))
    return {
        "metric_speeds_by_route_day": speeds,
        "metric_route_grades_by_month": routes,
        "metric_corridor_by_week": corridor,
        "metric_traffic_last_3_months": traffic,
        "metric_avg_speed_densified": densified,
        "auto_metrics_segment_speeds": auto,
        **{f"dq_{area}": with_blocks([c.model for c in specs], dq_oracle_sql(specs)) for area, specs in CHECKS.items()},
        "raw_table_counts": counts,
        "source_status": _status_sql(),
        "profile_orders": _profile_sql(),
        "auto_stage_commits": with_blocks(["raw_commits"], "select * exclude (_dlt_id) from raw_commits"),
        "alias_customers": "select * from customer",
    }
