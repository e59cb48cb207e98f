"""Readers, writers and nested normalisation on files written to a fresh temp dir."""

import datetime as dt
import hashlib
import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from tidewater.ops import freshness_label, last_sync
from tidewater.pipeline import append_then_dedup
from tidewater.sources.files import list_files, read_csv_dir, read_json_pages, read_parquet_dir, select_datasets, stack, text_schema
from tidewater.sources.nested import explode_child, flatten_structs, stamp_load
from tidewater.sources.sinks import record_load, table_path, write_table
from tidewater.sources.zipcsv import read_zip_csv


def test_csv_dir_recursive(spark, tmp):
    os.makedirs(f"{tmp}/a/b")
    for i, p in enumerate([f"{tmp}/one.csv", f"{tmp}/a/b/two.csv"]):
        with open(p, "w") as f:
            f.write("id,name\n" + "".join(f"{i}{j},n{j}\n" for j in range(3)))
    with open(f"{tmp}/skip.txt", "w") as f:
        f.write("not,csv\n")
    df = read_csv_dir(spark, tmp)
    assert df.count() == 6 and df.columns == ["id", "name"]


def test_parquet_merge_schema_and_list_files(spark, tmp):
    spark.createDataFrame([(1, "a")], "id int, x string").coalesce(1).write.parquet(f"{tmp}/p/part1")
    spark.createDataFrame([(2, 3.5)], "id int, y double").coalesce(1).write.parquet(f"{tmp}/p/part2")
    df = read_parquet_dir(spark, f"{tmp}/p")
    assert set(df.columns) == {"id", "x", "y"} and df.count() == 2
    files = list_files(spark, f"{tmp}/p", "*.parquet")
    assert files.columns == ["path", "modificationTime", "length"] and files.count() == 2


def test_json_pages_as_text(spark, tmp):
    for page in range(3):
        with open(f"{tmp}/page_{page}.json", "w") as f:
            json.dump([{"id": page * 10 + i, "speed": "12.5", "extra": {"a": 1}} for i in range(4)], f)
    df = read_json_pages(spark, tmp, schema=text_schema(["id", "speed"]))
    assert df.count() == 12 and dict(df.dtypes) == {"id": "string", "speed": "string"}


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in members.items():
            zf.writestr(name, text.encode("utf-8-sig") if name == "routes.txt" else text)


def test_zip_members_over_feeds(spark, tmp):
    _zip(f"{tmp}/bronx.zip", {"routes.txt": "route_id,route_short_name\nBX1,BX1\nBX2,BX2\n"})
    _zip(f"{tmp}/queens.zip", {"routes.txt": "route_id,route_short_name,extra\nQ1,Q1,e\n"})
    _zip(f"{tmp}/brooklyn.zip", {"stops.txt": "stop_id\n1\n"})  # member missing -> 0 rows
    df = read_zip_csv(spark, tmp, "routes.txt", ["route_id", "route_short_name"])
    rows = sorted((r.route_id, r.route_short_name, r._borough) for r in df.collect())
    assert rows == [("BX1", "BX1", "bronx"), ("BX2", "BX2", "bronx"), ("Q1", "Q1", "queens")]


def test_flatten_and_explode(spark):
    df = spark.createDataFrame(
        [(1, {"login": "u1", "profile": {"email": "e"}}, [{"name": "bug"}, {"name": "ui"}]), (2, None, [])],
        "id int, user struct<login:string, profile:struct<email:string>>, labels array<struct<name:string>>",
    )
    flat = flatten_structs(df, keep_arrays=False)
    assert flat.columns == ["id", "user__login", "user__profile__email"]
    child = explode_child(df, "id", "labels")
    assert sorted(tuple(r) for r in child.collect()) == [(1, 0, "bug"), (1, 1, "ui")]
    stamped = stamp_load(flat, "load-1")
    assert stamped.select("_dlt_id").distinct().count() == 2
    equal = stamp_load(spark.createDataFrame([(1, "a")] * 50, "id int, x string").repartition(4), "load-1")
    assert equal.select("_dlt_id").distinct().count() == 50


def test_row_ids_depend_on_the_rows_alone(spark):
    rows = [(i % 5, None if i % 3 else "x", -0.0 if i % 2 else 0.0) for i in range(60)] + [(7, "alone", 1.0)]
    df = spark.createDataFrame(rows, "id int, x string, z double")
    ids = [sorted(r._dlt_id for r in stamp_load(d, "l", **at).collect())
           for d, at in ((df, {}), (df.repartition(7), {}), (df.orderBy(F.rand(3)).coalesce(1), {"copies_at_once": 2}), (df.union(df.limit(0)), {"copies_at_once": 1}))]
    assert ids[0] == ids[1] == ids[2] == ids[3] and len(set(ids[0])) == len(rows)
    back = stamp_load(df, "l").drop("_dlt_id", "_dlt_load_id")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect())) and back.schema == df.schema
    # a third of all rows equal: each run of copies is a row of its own before they are written out
    hot = stamp_load(spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id")), "l", copies_at_once=100)
    assert hot.count() == 9000 == hot.select("_dlt_id").distinct().count()


def test_load_audit_and_freshness(spark, tmp):
    record_load(spark, tmp, "github", status=0, load_id="a", inserted_at="2024-01-31 20:00:00")
    record_load(spark, tmp, "github", status=1, load_id="b", inserted_at="2024-01-31 23:30:00")
    record_load(spark, tmp, "slack", status=0, load_id="c", inserted_at="2024-01-20 00:00:00")
    loads = spark.read.parquet(f"{tmp}/github/_loads").unionByName(spark.read.parquet(f"{tmp}/slack/_loads"))
    ls = last_sync(loads)
    label, colour = freshness_label(F.col("last_sync"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    got = {r.schema_name: (r.l, r.c) for r in ls.select("schema_name", label.alias("l"), colour.alias("c")).collect()}
    assert got == {"github": ("4h ago", "green"), "slack": ("12d ago", "red")}


def test_load_audit_grows_with_the_orders(spark):
    from tidewater.catalog_ingest import load_audit_orders
    from tests.conftest import SF_SMALL

    months = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "month")).distinct().count()
    rows = load_audit_orders(spark, SF_SMALL).collect()
    assert sum(r.load_count for r in rows) == months > 100 and 0 < sum(r.failed_count for r in rows) < months


def test_append_then_dedup(spark, tmp):
    b1 = spark.createDataFrame([("m1", 1, "first"), ("m2", 1, "x")], "id string, v int, text string")
    b2 = spark.createDataFrame([("m1", 2, "edited")], "id string, v int, text string")
    append_then_dedup(spark, tmp, "raw", "messages", b1, ["id"], [F.col("v").desc()])
    out = append_then_dedup(spark, tmp, "raw", "messages", b2, ["id"], [F.col("v").desc()])
    assert sorted((r.id, r.text) for r in out.collect()) == [("m1", "edited"), ("m2", "x")]


def test_write_table_replace(spark, tmp):
    df = spark.createDataFrame([(1,)], "x int")
    write_table(df, tmp, "stage", "t")
    write_table(df, tmp, "stage", "t")
    assert spark.read.parquet(table_path(tmp, "stage", "t")).count() == 1


def test_select_datasets_and_stack(spark):
    got = select_datasets({"2023-2024": "a", "2025": "b"}, (2024, 2025))
    assert got == {"bus_segment_speeds_2023_2024": "a", "bus_segment_speeds_2025": "b"}
    assert select_datasets({"2023-2024": "a", "2025": "b"}, (2025, 2025)) == {"bus_segment_speeds_2025": "b"}
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.0)], "id int, b double")
    s = stack(a, b)
    assert s.count() == 2 and set(s.columns) == {"id", "a", "b"}


def test_stamping_ships_the_hash_and_the_columns_in_use(spark):
    df = spark.createDataFrame([(1, "a", 2.0)] * 3, "id int, x string, z double")
    stamped = stamp_load(df, "l", copies_at_once=2).select("x", "_dlt_id")
    plan = stamped._jdf.queryExecution().optimizedPlan().toString()
    # columns that nobody reads are hashed where they are read, and the hash is 32 bytes, not 64 digits
    assert "first(c1" in plan and "first(c0" not in plan and "first(c2" not in plan and "unhex(sha2" in plan
    digits = hashlib.sha256(b'{"id":1,"x":"a","z":2.0}').hexdigest()
    assert sorted(tuple(r) for r in stamped.collect()) == [("a", f"{digits}-{i}") for i in range(3)]
