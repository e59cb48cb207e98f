"""Full run: land sources -> build over the landed tables -> checks; ad-hoc SQL."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.catalog_extra import CHECKS
from tidewater.ops import sql
from tidewater.pipeline import land_sources, run_all
from tidewater.registry import warehouse
from tidewater.sources.adapters import RAW_TABLES, DriverRaw
from tidewater.sources.nested import flatten_structs, normalised
from tidewater.sources.sinks import landed_status, published_table


def test_run_all_lands_builds_and_checks(spark, tmp):
    driver = DriverRaw(spark, SF_SMALL)
    source_of = {"bus_segment_speeds_2025": "mta_bus_speeds", "gtfs_routes": "mta", "gtfs_stops": "mta",
                 "bus_lanes": "nyc_dot", "traffic_volume_counts": "nyc_dot"}
    sources = {}
    for table, src in source_of.items():
        sources.setdefault(src, []).append(table)
    readers = {src: (lambda s, tabs=tabs: {t: driver(t) for t in tabs}) for src, tabs in sources.items()}
    checks = [c for c in CHECKS["transit"] if c.model in {"stg_bus_segment_speeds", "dim_bus_routes",
                                                          "fct_route_daily_performance"}]
    report = run_all(spark, tmp, readers, source_of,
                     ["dim_date", "fct_route_daily_performance", "rpt_route_reliability"], checks)
    rows = report.collect()
    assert rows and all((r.status == "pass") == (r.failing_rows == 0) for r in rows)
    # The declared not_null on the route-day average fails where every
    # segment speed of a route-day was 'n/a': the report counts exactly those.
    got = {(r.model, r.column_name, r.check_name): r.failing_rows for r in rows}
    direct = warehouse(spark, SF_SMALL).ref("fct_route_daily_performance")
    assert got[("fct_route_daily_performance", "route_avg_speed_mph", "not_null")] == \
        direct.where(F.col("route_avg_speed_mph").isNull()).count()
    assert got[("dim_bus_routes", "route_id", "unique")] == 0
    loads = spark.read.parquet(f"{tmp}/mta/_loads")
    assert loads.where(F.col("status") == 0).count() == 1
    # the landed build gives the same report as the direct one
    direct = warehouse(spark, SF_SMALL).ref("rpt_route_reliability")
    landed = spark.read.parquet(f"{tmp}/mta_bus_speeds/bus_segment_speeds_2025").count()
    assert landed == driver("bus_segment_speeds_2025").count()
    assert direct.count() == 10


def test_adhoc_sql_over_models(spark):
    w = warehouse(spark, SF_SMALL)
    df = sql(w, "select borough, count(*) as n from dim_bus_routes group by borough", ["dim_bus_routes"])
    assert sum(r.n for r in df.collect()) == w.ref("dim_bus_routes").count()


NESTED = """id long, user struct<login string, `homePage` struct<url string>>, tags array<string>,
    items array<struct<sku string, parts array<struct<n int>>>>"""
NESTED_ROWS = [
    (1, ("a", ("u1",)), ["x", None], [("s1", [(1,), (2,)]), ("s2", [])]),
    (2, None, None, None),
    (3, ("c", None), [], [("s3", [(3,)]), (None, None)]),
    (3, ("c", None), [], [("s3", [(3,)]), (None, None)]),
]


def test_nested_records_land_flat_with_children_at_any_depth(spark, tmp):
    nested = spark.createDataFrame(NESTED_ROWS, NESTED)
    keys = {"shop.orders": ["user__login"], "shop.orders__tags": ["value"]}
    landed = land_sources(spark, tmp, {"shop": lambda _: {"shop.orders": nested}}, keys, normalise=True, threads=3)
    assert set(landed) == {"shop.orders", "shop.orders__tags", "shop.orders__items", "shop.orders__items__parts"}
    back = {name.removeprefix("shop."): spark.read.parquet(path) for name, path in landed.items()}
    orders, tags, items, parts = (back[n].collect() for n in ("orders", "orders__tags", "orders__items", "orders__items__parts"))
    assert set(back["orders"].columns) == {"id", "user__login", "user__home_page__url", "_dlt_load_id", "_dlt_id"}
    for rows in (orders, tags, items, parts):
        assert len({r["_dlt_id"] for r in rows}) == len(rows)
    number = {r["_dlt_id"]: r["id"] for r in orders}
    assert sorted(number.values()) == [1, 2, 3, 3]  # equal rows keep ids of their own
    assert sorted((number[r["_dlt_parent_id"]], r["_dlt_list_idx"], r["value"]) for r in tags) == [(1, 0, "x"), (1, 1, None)]
    place = {r["_dlt_id"]: (number[r["_dlt_parent_id"]], r["sku"]) for r in items}
    assert sorted(place.values(), key=str) == [(1, "s1"), (1, "s2"), (3, "s3"), (3, "s3"), (3, None), (3, None)]
    assert sorted((*place[r["_dlt_parent_id"]], r["n"]) for r in parts) == [(1, "s1", 1), (1, "s1", 2), (3, "s3", 3), (3, "s3", 3)]
    status = landed_status(spark, tmp, ["shop"]).first()
    assert (status.table_count, status.total_rows, status.null_keys) == (4, 4 + 2 + 6 + 4, 2)


def test_rows_that_bring_an_id_keep_it_and_no_rows_give_no_children(spark):
    known = spark.createDataFrame([(1, "k1", [5])], "x int, _dlt_id string, l array<int>")
    tables = normalised(known, "t", "load")
    assert [tuple(r) for r in tables["t"].select("x", "_dlt_id", "_dlt_load_id").collect()] == [(1, "k1", "load")]
    assert tables["t__l"].select("_dlt_parent_id", "_dlt_id", "value").first() == ("k1", "k1-0", 5)
    empty = normalised(known.limit(0), "t", "load")
    assert {n: t.count() for n, t in empty.items()} == {"t": 0, "t__l": 0}


def test_raw_names_stay_when_flattened(spark):
    raw = DriverRaw(spark, SF_SMALL)
    for name in RAW_TABLES:
        assert flatten_structs(raw(name)).columns == raw(name).columns


def test_full_run_publishes_what_it_built(spark):
    from tidewater.catalog_runs import full_run_saas

    report = full_run_saas(spark, SF_SMALL).collect()
    assert {r.model for r in report} == {c.model for c in CHECKS["saas"]}
    direct = warehouse(spark, SF_SMALL).ref("slack_user_activity")
    published = published_table(spark, "slack_user_activity")
    assert published.exceptAll(direct).count() == 0 == direct.exceptAll(published).count()
