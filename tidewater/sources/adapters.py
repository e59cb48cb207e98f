"""Raw source tables derived from the driver's parquet tables.

The reference lands public transit feeds and SaaS APIs as raw tables.  The
test and bench data is a TPC-H-like set, so every raw table the models read
is derived here from those tables with plain column expressions (the
derivations are documented in FIXTURES.md section 2).  They are ordinary
lazy DataFrames: their work grows with the driver tables and Catalyst prunes
the columns a model does not use.

Numbers that the real feeds deliver as text are produced as text, so the
staging models exercise the same casts as on the real data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --- fixed values -----------------------------------------------------------
ROUTE_PREFIXES = ["Q", "BX", "B", "M", "S", "X"]
GTFS_FEEDS = ["bronx", "brooklyn", "manhattan", "queens", "staten_island", "bus_company"]
LANE_TYPES = ["Curb", "Offset", "Median"]
DIRECTIONS = ["NB", "SB", "EB", "WB"]
TRAFFIC_BOROS = ["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island"]
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ONE_REACTION = '[{"name":"thumbsup","count":1}]'
SEGMENT_STOPS = 40
# ---------------------------------------------------------------------------


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FMT)


def _plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))


def _plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def _epoch_text(ts: Column) -> Column:
    """Epoch seconds as '<secs>.<6-digit micros>' built from integer micros."""
    us = F.unix_micros(ts.cast("timestamp"))
    frac = F.pmod(us, F.lit(1_000_000))
    secs = ((us - frac) / F.lit(1_000_000)).cast("long")  # exact: multiple of 1e6
    return F.concat(_s(secs), F.lit("."), F.lpad(_s(frac), 6, "0"))


class DriverTables:
    """Lazy readers for ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def route_id_expr(suppkey: Column) -> Column:
    return F.concat(_pick(ROUTE_PREFIXES, suppkey % 6), _s(suppkey % 10))


def bus_segment_speeds(t: DriverTables) -> DataFrame:
    li = t("lineitem")
    q = F.col("l_quantity").cast("int")
    stop = _s(F.col("l_partkey") % SEGMENT_STOPS)
    nxt = _s((F.col("l_partkey") + 7) % SEGMENT_STOPS)
    return li.select(
        route_id_expr(F.col("l_suppkey")).alias("route_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("N")).otherwise(F.lit("S")).alias("direction"),
        F.col("l_returnflag").alias("borough"),
        F.col("l_linestatus").alias("route_type"),
        stop.alias("timepoint_stop_id"),
        F.concat(F.lit("NATION_"), stop, F.lit(" AVE")).alias("timepoint_stop_name"),
        F.concat(F.lit("40."), F.lpad(stop, 2, "0")).alias("timepoint_stop_latitude"),
        F.concat(F.lit("-73."), F.lpad(stop, 2, "0")).alias("timepoint_stop_longitude"),
        nxt.alias("next_timepoint_stop_id"),
        F.concat(F.lit("NATION_"), nxt, F.lit(" AVE")).alias("next_timepoint_stop_name"),
        F.concat(F.lit("40."), F.lpad(nxt, 2, "0")).alias("next_timepoint_stop_latitude"),
        F.concat(F.lit("-73."), F.lpad(nxt, 2, "0")).alias("next_timepoint_stop_longitude"),
        _s(F.lit(2022) + (F.year("l_shipdate") - F.lit(1995)) % 6).alias("year"),
        _s(F.month("l_shipdate")).alias("month"),
        F.date_format("l_shipdate", "EEEE").alias("day_of_week"),
        _s((F.col("l_partkey") + F.col("l_linenumber")) % 24).alias("hour_of_day"),
        F.concat(_s(q % 9 + 1), F.lit(".5")).alias("road_distance"),
        F.concat(_s(F.col("l_linenumber")), F.lit(".25")).alias("average_travel_time"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), F.lit("n/a"))
        .otherwise(F.concat(_s(q % 25), F.lit(".5")))
        .alias("average_road_speed"),
        _s(F.col("l_linenumber") * 3).alias("bus_trip_count"),
        _s(F.col("l_linenumber")).alias("stop_order"),
        F.col("l_shipdate").alias("timestamp"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_dlt_id"),
    )


def bus_segment_speeds_2023_2024(t: DriverTables) -> DataFrame:
    """The earlier dataset: the same feed shape, observations two years back
    (years 2023 / 2024 by order parity), delivered with a second feed layout
    (no stop coordinates)."""
    cur = bus_segment_speeds(t)
    li_year = F.lit(2023) + F.split(F.col("_dlt_id"), "-").getItem(0).cast("long") % 2
    return cur.select(
        *[F.col(x) for x in cur.columns if x not in ("year", "timestamp") and not x.endswith(("latitude", "longitude"))],
        li_year.cast("string").alias("year"),
        (F.col("timestamp") - F.make_ym_interval(F.lit(2), F.lit(0))).alias("timestamp"),
    )


def gtfs_routes(t: DriverTables) -> DataFrame:
    # A route list is a small reference feed: derived from the supplier
    # table (the route key rule of the speeds feed), not from a scan of the
    # largest fact table.
    base = t("supplier").select((F.col("s_suppkey") % 60).alias("k")).distinct()
    rid = route_id_expr(F.col("k"))
    return base.select(
        rid.alias("route_id"),
        rid.alias("route_short_name"),
        F.concat(F.lit("Route "), rid).alias("route_long_name"),
        F.lit("3").alias("route_type"),
        F.lit("0039A6").alias("route_color"),
        F.lit("FFFFFF").alias("route_text_color"),
        _pick(GTFS_FEEDS, F.col("k") % 6).alias("_borough"),
    )


def gtfs_stops(t: DriverTables) -> DataFrame:
    p = t("part")
    return p.select(
        _s(F.col("p_partkey")).alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        F.concat(F.lit("40."), F.lpad(_s(F.col("p_partkey") % 10000), 4, "0")).alias("stop_lat"),
        F.concat(F.lit("-73."), F.lpad(_s((F.col("p_partkey") * 7) % 10000), 4, "0")).alias("stop_lon"),
        _pick(GTFS_FEEDS, F.col("p_partkey") % 6).alias("_borough"),
    )


def bus_lanes(t: DriverTables) -> DataFrame:
    s = t("supplier")
    n = F.broadcast(t("nation"))  # 25 rows: the static nation list
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "inner")
    k = F.col("s_suppkey")
    lane_type = _pick(LANE_TYPES, k % 3)
    return j.select(
        F.concat(F.col("n_name"), F.lit(" AVE")).alias("street"),
        _s(k).alias("segmentid"),
        _s(F.col("n_regionkey")).alias("boro"),
        F.lit("Bus Lane").alias("facility"),
        _pick(DIRECTIONS, k % 4).alias("direction"),
        F.lit("7AM-7PM").alias("hours"),
        F.lit("Mon-Fri").alias("days"),
        lane_type.alias("lane_type"),
        lane_type.alias("lane_type1"),
        F.lit(None).cast("string").alias("lane_type2"),
        _s(F.lit(2000) + k % 25).alias("open_dates"),
        F.lit("11").alias("lane_width"),
        F.lit("Red").alias("lane_color"),
        route_id_expr(k).alias("sbs_route1"),
        F.lit(None).cast("string").alias("sbs_route2"),
        F.lit("With").alias("bltrafdir"),
        F.lit("1").alias("rw_type"),
        _s(F.lit(30) + k % 40).alias("streetwidt"),
        F.concat(_s(k * 10 + 5), F.lit(".5")).alias("shape_leng"),
    )


def traffic_volume_counts(t: DriverTables) -> DataFrame:
    o = t("orders")
    seg = _s(F.col("o_custkey") % 50)
    return o.select(
        seg.alias("segmentid"),
        _s(F.col("o_orderkey")).alias("requestid"),
        F.concat(F.lit("NATION_"), seg, F.lit(" AVE")).alias("street"),
        F.concat(F.lit("NATION_"), _s((F.col("o_custkey") + 1) % 50), F.lit(" AVE")).alias("fromst"),
        F.concat(F.lit("NATION_"), _s((F.col("o_custkey") + 2) % 50), F.lit(" AVE")).alias("tost"),
        _pick(DIRECTIONS, F.col("o_custkey") % 4).alias("direction"),
        _pick(TRAFFIC_BOROS, F.col("o_custkey") % 5).alias("boro"),
        F.lit("POINT (0 0)").alias("wktgeom"),
        _s(F.year("o_orderdate")).alias("yr"),
        _s(F.month("o_orderdate")).alias("m"),
        _s(F.dayofmonth("o_orderdate")).alias("d"),
        _s(F.col("o_orderkey") % 24).alias("hh"),
        _s(F.col("o_orderkey") % 4 * 15).alias("mm"),
        F.when(F.col("o_orderkey") % 101 == 0, F.lit(None).cast("string"))
        .otherwise(_s(F.col("o_orderkey") % 500))
        .alias("vol"),
    )


def github_commits(t: DriverTables) -> DataFrame:
    e = t("events")
    return e.select(
        F.md5(_s(F.col("event_id") % 9000)).alias("sha"),
        F.concat(F.lit("m"), _s(F.col("event_id"))).alias("commit__message"),
        F.concat(F.lit("Author "), _s(F.col("user_id"))).alias("commit__author__name"),
        F.concat(F.lit("u"), _s(F.col("user_id")), F.lit("@example.com")).alias("commit__author__email"),
        _iso(F.col("ts")).alias("commit__author__date"),
        _iso(_plus_hours(F.col("ts"), F.lit(1))).alias("commit__committer__date"),
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("author__login"),
        F.concat(F.lit("u"), _s(F.col("user_id") % 10)).alias("committer__login"),
        (F.col("event_id") % 97).alias("stats__additions"),
        (F.col("event_id") % 31).alias("stats__deletions"),
        (F.col("event_id") % 97 + F.col("event_id") % 31).alias("stats__total"),
        _s(F.col("event_id")).alias("_dlt_id"),
    )


def github_issues(t: DriverTables) -> DataFrame:
    o = t("orders")
    k = F.col("o_orderkey")
    closed = F.col("o_orderstatus") != "O"
    num = k % 7919 + 1
    return o.select(
        num.alias("id"),
        num.alias("number"),
        F.concat(F.lit("Issue "), _s(num)).alias("title"),
        F.col("o_orderpriority").alias("body"),
        F.when(closed, F.lit("closed")).otherwise(F.lit("open")).alias("state"),
        _iso(F.col("o_orderdate")).alias("created_at"),
        _iso(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1000).cast("int"), F.lit(0))).alias(
            "updated_at"
        ),
        F.when(closed, _iso(_plus_hours(F.col("o_orderdate"), F.col("o_custkey") % 200))).alias("closed_at"),
        F.concat(F.lit("u"), _s(F.col("o_custkey") % 150)).alias("user__login"),
        (F.col("o_custkey") % 150).alias("user__id"),
        F.lit("[]").alias("labels"),
        F.lit("[]").alias("assignees"),
        F.when(k % 3 == 0, F.lit('{"merged": false}')).alias("pull_request"),
        (k % 7).alias("comments"),
        (k % 5).alias("reactions__total_count"),
        _s(k).alias("_dlt_id"),
    )


def github_pull_requests(t: DriverTables) -> DataFrame:
    o = t("orders")
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    done = _plus_hours(F.col("o_orderdate"), F.col("o_custkey") % 200)
    return o.select(
        k.alias("id"),
        k.alias("number"),
        F.concat(F.lit("PR "), _s(k)).alias("title"),
        F.when(st == "O", F.lit("open")).otherwise(F.lit("closed")).alias("state"),
        _iso(F.col("o_orderdate")).alias("created_at"),
        _iso(_plus_hours(F.col("o_orderdate"), F.col("o_custkey") % 200 + 1)).alias("updated_at"),
        F.when(st == "F", _iso(done)).alias("merged_at"),
        F.when(st.isin("F", "P"), _iso(done)).alias("closed_at"),
        F.concat(F.lit("u"), _s(F.col("o_custkey") % 150)).alias("user__login"),
        (k % 2 == 0).alias("draft"),
        F.lit("[]").alias("requested_reviewers"),
        F.concat(F.lit("feature-"), _s(k)).alias("head__ref"),
        F.lit("main").alias("base__ref"),
        (k % 500).alias("additions"),
        (k % 200).alias("deletions"),
        (k % 20).alias("changed_files"),
        (k % 10 + 1).alias("commits"),
        (k % 6).alias("review_comments"),
        _s(k).alias("_dlt_id"),
    )


def slack_messages(t: DriverTables) -> DataFrame:
    e = t("events")
    et = F.col("event_type")
    ts_text = _epoch_text(F.col("ts"))
    return e.select(
        ts_text.alias("ts"),
        F.concat(F.lit("C"), _s(F.col("user_id") % 20)).alias("channel"),
        F.concat(F.lit("msg "), _s(F.col("event_id"))).alias("text"),
        F.when(et == "error", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("U"), _s(F.col("user_id"))))
        .alias("user"),
        F.lit("message").alias("type"),
        F.when(et == "error", F.lit("bot_message")).when(et == "signup", F.lit("channel_join")).alias("subtype"),
        F.when((et == "view") & (F.col("event_id") % 3 == 0), ts_text)
        .when(et == "view", F.lit("1704067200.000000"))
        .alias("thread_ts"),
        F.when(F.col("event_id") % 5 == 0, _s(F.col("event_id") % 3)).alias("reply_count"),
        F.when(et == "purchase", F.lit(ONE_REACTION)).when(et == "click", F.lit("[]")).alias("reactions"),
        F.lit(None).cast("string").alias("files"),
        F.lit(None).cast("string").alias("attachments"),
        F.lit(None).cast("string").alias("blocks"),
        _s(F.col("event_id")).alias("_dlt_id"),
    )


def slack_channels(t: DriverTables) -> DataFrame:
    base = t("events").select((F.col("user_id") % 20).alias("n")).distinct()
    n = F.col("n")
    return base.select(
        F.concat(F.lit("C"), _s(n)).alias("id"),
        F.concat(F.lit("chan-"), _s(n)).alias("name"),
        (n % 5 == 0).alias("is_private"),
        (n % 7 == 0).alias("is_archived"),
        F.concat(F.lit("topic "), _s(n)).alias("topic__value"),
        F.concat(F.lit("purpose "), _s(n)).alias("purpose__value"),
        (n * 3 + 1).alias("num_members"),
        (F.lit(1600000000) + n * 86400).cast("long").alias("created"),
        (F.lit(1600003600) + n * 86400).cast("long").alias("updated"),
    )


def slack_users(t: DriverTables) -> DataFrame:
    base = t("events").select(F.col("user_id").alias("u")).distinct()
    u = F.col("u")
    return base.select(
        F.concat(F.lit("U"), _s(u)).alias("id"),
        F.concat(F.lit("user-"), _s(u)).alias("name"),
        F.concat(F.lit("User "), _s(u)).alias("real_name"),
        F.concat(F.lit("u"), _s(u)).alias("display_name"),
        (u % 19 == 0).alias("is_bot"),
        (u % 31 == 0).alias("is_admin"),
        (u % 97 == 0).alias("is_owner"),
        (u % 23 == 0).alias("deleted"),
        F.lit("UTC").alias("tz"),
        F.concat(F.lit("user"), _s(u), F.lit("@example.com")).alias("profile__email"),
        F.lit("Member").alias("profile__title"),
        F.lit(None).cast("string").alias("profile__image_72"),
    )


def notion_pages(t: DriverTables) -> DataFrame:
    d = t("documents")
    doc = F.col("doc_id")
    created = _plus_hours(_plus_days(F.lit("2024-01-01 09:30:00").cast("timestamp_ntz"), doc % 28), doc % 7)
    edited = _plus_hours(created, doc % 50)
    standalone = doc % 4 == 0
    return d.select(
        _s(doc).alias("id"),
        F.concat(F.lit("page/"), _s(doc)).alias("url"),
        _iso(created).alias("created_time"),
        _iso(edited).alias("last_edited_time"),
        F.concat(F.lit("u"), _s(doc % 17)).alias("created_by__id"),
        F.concat(F.lit("u"), _s(doc % 13)).alias("last_edited_by__id"),
        F.when(standalone, F.lit(None).cast("string")).otherwise(F.col("source")).alias("parent__database_id"),
        F.when(standalone, F.lit("workspace")).otherwise(F.lit("database_id")).alias("parent__type"),
        (doc % 11 == 0).alias("archived"),
        F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')).alias("properties"),
    )


def notion_databases(t: DriverTables) -> DataFrame:
    base = t("documents").select("source").distinct()
    s = F.col("source")
    return base.select(
        s.alias("id"),
        F.concat(F.lit('[{"plain_text":"DB '), s, F.lit('"}]')).alias("title"),
        F.lit("[]").alias("description"),
        F.concat(F.lit("db/"), s).alias("url"),
        F.lit("2023-06-01T00:00:00Z").alias("created_time"),
        F.lit("2024-01-01T00:00:00Z").alias("last_edited_time"),
        F.lit("u0").alias("created_by__id"),
        F.lit("u1").alias("last_edited_by__id"),
        F.lit("{}").alias("properties"),
    )


def notion_users(t: DriverTables) -> DataFrame:
    base = t("documents").select((F.col("doc_id") % 17).alias("n")).distinct()
    n = F.col("n")
    person = n % 5 != 0
    return base.select(
        F.concat(F.lit("u"), _s(n)).alias("id"),
        F.when(person, F.lit("person")).otherwise(F.lit("bot")).alias("type"),
        F.concat(F.lit("Notion User "), _s(n)).alias("name"),
        F.lit(None).cast("string").alias("avatar_url"),
        F.lit("user").alias("object"),
        F.when(person, F.concat(F.lit("n"), _s(n), F.lit("@example.com"))).alias("person__email"),
    )


RAW_TABLES = {
    "bus_segment_speeds_2025": bus_segment_speeds,
    "bus_segment_speeds_2023_2024": bus_segment_speeds_2023_2024,
    "gtfs_routes": gtfs_routes,
    "gtfs_stops": gtfs_stops,
    "bus_lanes": bus_lanes,
    "traffic_volume_counts": traffic_volume_counts,
    "github.commits": github_commits,
    "github.issues": github_issues,
    "github.pull_requests": github_pull_requests,
    "slack.messages": slack_messages,
    "slack.channels": slack_channels,
    "slack.users": slack_users,
    "notion.pages": notion_pages,
    "notion.databases": notion_databases,
    "notion.users": notion_users,
}


class DriverRaw:
    """Raw layer backed by the driver tables: ``raw('gtfs_routes')``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = DriverTables(spark, sf_dir)
        self.spark = spark

    def __call__(self, name: str) -> DataFrame:
        return RAW_TABLES[name](self.tables)
