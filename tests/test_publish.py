import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.sources import publish as P


def order():
    return [F.desc_nulls_last("v")]


def files(root):
    """Data files of a table with their change times."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, day string, v int")


def read(spark, root, number=None):
    return sorted((tuple(r) for r in P.published(spark, root, "marts", "t", number).collect()), key=repr)


def test_newest_version_is_found_by_another_session(spark, tmp):
    P.publish(frame(spark, [(1, "a", 1)]), tmp, "marts", "t")
    first = P.published(spark, tmp, "marts", "t")
    P.publish(frame(spark, [(2, "b", 2), (3, None, 3)]), tmp, "marts", "t", ["day"])
    assert read(spark.newSession(), tmp) == [(2, "b", 2), (3, None, 3)]
    assert P.published(spark, tmp, "marts", "t").schema == frame(spark, []).schema  # places and types kept over partitions
    # a reader of the old version, and the old version by its number, are not disturbed
    assert [tuple(r) for r in first.collect()] == read(spark, tmp, 1) == [(1, "a", 1)]


def test_a_build_that_dies_leaves_the_old_version(spark, tmp):
    P.publish(frame(spark, [(1, "a", 1)]), tmp, "marts", "t")
    broken = frame(spark, [(1, "a", 1), (2, "b", 0)]).repartition(2).withColumn("v", F.expr("if(v = 0, cast(raise_error('dies') as int), v)"))
    with pytest.raises(Exception, match="dies"):
        P.publish(broken, tmp, "marts", "t")
    assert read(spark, tmp) == [(1, "a", 1)] and P.versions(spark, f"{tmp}/marts/t") == [1]
    # rows written, but the pointer torn
    P._write(frame(spark, [(9, "z", 9)]), f"{tmp}/marts/t", [])
    P._create_text(spark, f"{tmp}/marts/t/_versions/{2:012d}.json", '{"schema"')
    assert read(spark, tmp) == [(1, "a", 1)]
    P.publish(frame(spark, [(5, "c", 5)]), tmp, "marts", "t")
    assert read(spark, tmp) == [(5, "c", 5)]


def test_two_writers_take_two_numbers(spark, tmp):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: P.publish(frame(spark, [(i, "a", i)]), tmp, "marts", "t"), range(4)))
    assert P.versions(spark, f"{tmp}/marts/t") == [1, 2, 3, 4]
    assert sorted(r for n in range(1, 5) for r in read(spark, tmp, n)) == [(i, "a", i) for i in range(4)]


def test_missing_table(spark, tmp):
    with pytest.raises(FileNotFoundError):
        P.published(spark, tmp, "marts", "nothing")


def merged(old, new):
    best = {}
    for r in sorted(old + new, key=lambda r: (r[2] is None, -(r[2] or 0))):
        best.setdefault(r[0], r)
    return sorted(best.values(), key=repr)


def test_upsert_equals_a_full_dedup(spark, tmp):
    """Moved keys, null keys, null and emptied partitions, new partitions, rows that lose against old ones."""
    rng = random.Random(7)
    days = ["a", "b", "c", "d e/f=g", None]
    rows = [(i, rng.choice(days), rng.randrange(100)) for i in range(60)] + [(None, "a", 5), (100, "only", 1)]
    P.publish(frame(spark, rows), tmp, "marts", "t", ["day"])
    for step in range(3):
        batch = [(i, rng.choice(days), 100 + step) for i in rng.sample(range(60), 4)] + [(70 + step, f"new{step}", 1), (3, "a", -1)]
        batch += [(None, "b", 50 + step), (100, "a", 60 + step)]
        keys = {r[0] for r in batch}
        held = {r[1] for r in rows if r[0] in keys} | {r[1] for r in batch}
        touched = P.upsert(frame(spark, batch).repartition(3), tmp, "marts", "t", ["id"], order())
        assert set(touched) == {P.NULL_PARTITION if d is None else d for d in held}
        rows = merged(rows, batch)
        assert read(spark, tmp) == rows
    assert P.upsert(frame(spark, []), tmp, "marts", "t", ["id"], order()) == []


def test_untouched_partitions_stay_the_same_files(spark, tmp):
    rows = [(i, f"d{i % 20}", 1) for i in range(400)]
    P.publish(frame(spark, rows), tmp, "marts", "t", ["day"])
    before = files(f"{tmp}/marts/t")
    batch = [(i, f"d{i % 20}", 2) for i in range(400) if i % 20 in (3, 4)]
    assert P.upsert(frame(spark, batch), tmp, "marts", "t", ["id"], order()) == ["d3", "d4"]
    after = files(f"{tmp}/marts/t")
    assert before.items() <= after.items()
    assert {f.split("day=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"d3", "d4"}
    # what the new version reads: the old files of 18 partitions and the new ones of two
    used = {f.removeprefix("file://").removeprefix("file:") for f in P.published(spark, tmp, "marts", "t").inputFiles()}
    assert {f.split("day=")[1].split("/")[0] for f in used if f in before} >= {f"d{i}" for i in range(20) if i not in (3, 4)}
    assert read(spark, tmp) == merged(rows, batch) and read(spark, tmp, 1) == sorted(rows, key=repr)


def test_vacuum_removes_only_what_no_kept_version_needs(spark, tmp):
    P.publish(frame(spark, [(1, "x", 0)]), tmp, "marts", "t", ["day"])
    P.publish(frame(spark, [(i, f"d{i}", 1) for i in range(4)]), tmp, "marts", "t", ["day"])
    P.upsert(frame(spark, [(1, "d1", 2)]), tmp, "marts", "t", ["id"], order())
    P.upsert(frame(spark, [(2, "d2", 2)]), tmp, "marts", "t", ["id"], order())
    assert len(P.vacuum(spark, tmp, "marts", "t", keep=2)) == 1  # the first version's folder alone
    assert read(spark, tmp) == [(0, "d0", 1), (1, "d1", 2), (2, "d2", 2), (3, "d3", 1)]
    assert read(spark, tmp, 3) == [(0, "d0", 1), (1, "d1", 2), (2, "d2", 1), (3, "d3", 1)]
    assert P.vacuum(spark, tmp, "marts", "t", keep=1) == [] and P.versions(spark, f"{tmp}/marts/t") == [4]


def test_a_second_session_reads_the_marts(spark):
    from tidewater.registry import warehouse
    from tidewater.sources.sinks import published_table

    built = warehouse(spark, SF_SMALL, materialize=["dim_bus_routes"]).ref("dim_bus_routes")
    found = published_table(spark.newSession(), "dim_bus_routes")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, built.collect())) and found.schema == built.schema
