"""Queries for ZIP feeds, rollups of mergeable states and the audit of landing writes over whole driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.casts import try_cast_int, try_cast_long
from tidewater.metrics.rollup import GRAINS, build_rollup
from tidewater.ops import freshness_label
from tidewater.pipeline import land_sources
from tidewater.session import apply_result_conf, checkpoint_dir
from tidewater.sources.sinks import landed_status
from tidewater.sources.zipcsv import read_zip_csv, write_zip_csv
from tidewater.verify.oracle import with_blocks

# --- fixed values: the sales feeds, their key columns, their newest data's time ----
SALES_FEEDS = {
    "sales": {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]},
    "supply": {"supplier": ["s_suppkey"], "part": ["p_partkey"]},
    "places": {"nation": ["n_nationkey"], "region": ["r_regionkey"]},
}
LANDED_AT = {"sales": "2024-01-31 23:30:00", "supply": "2024-01-31 02:00:00", "places": "2024-01-20 00:00:00"}
STATUS_AS_OF = "2024-02-01 00:00:00"
# ----------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_result_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/feeds-{uuid.uuid4().hex}"


def ingest_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, SET-3: all lines in archives of five feeds, a third of the rows in one of them, split in volumes;
    the archives of nation names beside them lack the member."""
    path, lines = _root(spark), _table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    feed = F.when(k % 3 == 0, F.lit("feed0")).otherwise(F.concat(F.lit("feed"), (k % 4 + 1).cast("string")))
    written = write_zip_csv(lines.withColumn("feed", feed), path, "lines.txt", "feed", volumes=8)
    other = write_zip_csv(_table(spark, sf_dir, "nation").withColumn("feed", F.lit("nations")), path, "names.txt", "feed")
    # the writers' reports are tables of a row per archive
    written.unionByName(other).write.parquet(f"{path}/_written")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "not_there"]
    back = read_zip_csv(spark, path, "lines.txt", cols, tag_col="feed", feed_pattern=r"([^/]+)-\d+\.zip$")
    return back.select(
        "feed", try_cast_long("l_orderkey").alias("l_orderkey"), try_cast_int("l_linenumber").alias("l_linenumber"),
        try_cast_long("l_partkey").alias("l_partkey"), F.col("l_quantity").try_cast("double").alias("l_quantity"),
        "l_returnflag", "not_there")


def _from_rollup(spark: SparkSession, sf_dir: str, name: str, by: list[str], digits: int | None) -> DataFrame:
    """A measure of the speeds' semantic model at every grain, all from one published rollup by day, route and hour."""
    from tidewater.catalog_extra import speeds_semantic
    from tidewater.registry import warehouse

    model = speeds_semantic(warehouse(spark, sf_dir))
    rollup = build_rollup(model, ["route_id", "hour_of_day"], _root(spark), "segment_speeds")
    out = None
    for grain in GRAINS:
        part = rollup.metric(name, by, grain, digits).select(F.lit(grain).alias("grain"), "period", *by, name)
        out = part if out is None else out.unionByName(part)
    return out


def metric_total_bus_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-4: trips by day, week, month, quarter and year, from the rollup."""
    return _from_rollup(spark, sf_dir, "total_bus_trips", [], None)


def metric_avg_segment_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-4: average travel time by route at every grain, from the rollup's sums and counts."""
    return _from_rollup(spark, sf_dir, "avg_segment_travel_time", ["route_id"], 6)


def metric_total_road_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-3: road miles by hour of day at every grain, from the rollup."""
    out = _from_rollup(spark, sf_dir, "total_road_distance_miles", ["hour_of_day"], None)
    return out.withColumn("total_road_distance_miles", F.round(F.col("total_road_distance_miles") * 1e4 + 1e-3) / 1e4)


def landing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, OPS-5: all sales tables landed, and the status of their sources read from the audit that the writes left."""
    root = _root(spark)
    land_sources(
        spark, root, {s: (lambda _, names=tuple(t): {n: _table(spark, sf_dir, n) for n in names}) for s, t in SALES_FEEDS.items()},
        keys={n: k for t in SALES_FEEDS.values() for n, k in t.items()}, inserted_at=LANDED_AT)
    found = landed_status(spark, root, list(SALES_FEEDS))
    label, colour = freshness_label(F.col("last_sync"), F.lit(STATUS_AS_OF).cast("timestamp_ntz"))
    return found.select("*", label.alias("freshness"), colour.alias("freshness_color"))


QUERIES = {
    f.__name__: f
    for f in (ingest_zip, metric_total_bus_trips, metric_avg_segment_travel_time, metric_total_road_distance, landing_status)
}


def _grains_sql(value: str, by: str = "") -> str:
    parts = (
        f"select '{g}' as grain, cast(date_trunc('{g}', metric_date) as date) as period, {by}{value} from sem_bus_segment_speeds group by all"
        for g in GRAINS
    )
    return with_blocks(["sem_bus_segment_speeds"], "\nunion all\n".join(parts))


def _status_sql() -> str:
    """Counts of the driver tables; ages and labels as the fixed times above give them by hand."""
    labels = {"sales": ("30m ago", "green"), "supply": ("22h ago", "green"), "places": ("12d ago", "red")}
    parts = []
    for source, tables in SALES_FEEDS.items():
        rows = " + ".join(f"(select count(*) from {t})" for t in tables)
        nulls = " + ".join(f"(select count(*) from {t} where {' or '.join(f'{k} is null' for k in keys)})" for t, keys in tables.items())
        freshness, colour = labels[source]
        parts.append(
            f"select '{source}' as source, {len(tables)}::bigint as table_count, {rows} as total_rows, {nulls} as null_keys, "
            f"timestamp '{LANDED_AT[source]}' as last_sync, '{freshness}' as freshness, '{colour}' as freshness_color")
    return "\nunion all\n".join(parts)


ORACLES = {
    "ingest_zip": """
        select case when l_orderkey % 3 = 0 then 'feed0' else 'feed' || (l_orderkey % 4 + 1) end as feed,
          l_orderkey, l_linenumber, l_partkey, l_quantity::double as l_quantity, l_returnflag, null::varchar as not_there
        from lineitem""",
    "metric_total_bus_trips": _grains_sql("cast(sum(trip_count) as bigint) as total_bus_trips"),
    "metric_avg_segment_travel_time": _grains_sql(
        "round(avg(avg_travel_time_min) * 1e6 + 1e-4) / 1e6 as avg_segment_travel_time", "route_id, "),
    "metric_total_road_distance": _grains_sql(
        "round(sum(road_distance_miles) * 1e4 + 1e-3) / 1e4 as total_road_distance_miles", "hour_of_day, "),
    "landing_status": _status_sql(),
}
