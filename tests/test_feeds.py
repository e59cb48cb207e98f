"""ZIP feeds by path, rollups of states, several distinct counts, and the audit that landing writes."""

import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.metrics import SemanticModel
from tidewater.metrics.rollup import build_rollup, open_rollup
from tidewater.operators import sums_and_distincts
from tidewater.pipeline import land_sources
from tidewater.sources.sinks import landed_status
from tidewater.sources.zipcsv import read_zip_csv, write_zip_csv

ODD = ['plain', 'with, comma', 'with "quotes"', 'two\nlines', '  spaces ', 'Ünï', '*']


def test_zip_round_trip_keeps_odd_texts_and_splits_a_hot_feed(spark, tmp):
    rows = [("hot" if i % 3 else f"f{i % 4}", i, ODD[i % len(ODD)], None if i % 5 == 0 else i / 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "feed string, id long, note string, x double")
    written = write_zip_csv(df, f"{tmp}/zips", "m.txt", "feed", volumes=4).collect()
    assert sum(r.rows for r in written) == 2000
    assert {r.volume for r in written if r.feed == "hot"} == {0, 1, 2, 3}
    back = read_zip_csv(spark, f"{tmp}/zips", "m.txt", ["id", "note", "x", "absent"], "feed", r"([^/]+)-\d+\.zip$")
    got = sorted((r.feed, int(r.id), r.note, float(r.x) if r.x else None, r.absent) for r in back.collect())
    assert got == sorted((*r, None) for r in rows)


def test_zip_by_content_equals_by_path_and_other_members_give_nothing(spark, tmp):
    with zipfile.ZipFile(f"{tmp}/a b.zip", "w") as zf:
        zf.writestr("m.txt", "﻿id\n1\n2\n".encode())
    with zipfile.ZipFile(f"{tmp}/empty.zip", "w") as zf:
        zf.writestr("other.txt", "id\n9\n")
    for how in ({}, {"opener": None}):
        got = read_zip_csv(spark, tmp, "m.txt", ["id"], "feed", **how).collect()
        assert sorted((r.id, r.feed) for r in got) == [("1", "a b"), ("2", "a b")]


def test_zip_of_no_rows(spark, tmp):
    df = spark.createDataFrame([], "feed string, id long")
    assert write_zip_csv(df, f"{tmp}/none", "m.txt", "feed").collect() == []


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(3)
    rows = [
        (f"2024-0{rng.randint(1, 3)}-{rng.randint(10, 28)}" if rng.random() > 0.05 else None, rng.choice("ab"), rng.randint(0, 9) if rng.random() > 0.2 else None,
         rng.randint(1, 99)) for _ in range(800)
    ]
    return spark.createDataFrame(rows, "day string, k string, v int, w int").withColumn("day", F.col("day").cast("date")), rows


def test_rollup_answers_coarser_grains_without_the_fact(spark, facts, tmp):
    df, rows = facts
    measures = {"mean_v": ("average", "v"), "sum_w": ("sum", "w"), "n_v": ("count", "v"), "top_w": ("max", "w")}
    build_rollup(SemanticModel(df, "day", measures), ["k"], tmp, "r")
    rollup = open_rollup(spark.newSession(), tmp, "r", ["k"], measures)
    by_month = defaultdict(list)
    for day, k, v, w in rows:
        by_month[day[:7] if day else None, k].append((v, w))
    want = {}
    for key, at in by_month.items():
        vs = [v for v, _ in at if v is not None]
        want[key] = (sum(vs) / len(vs) if vs else None, sum(w for _, w in at), len(vs), max(w for _, w in at))
    got = defaultdict(dict)
    for name in measures:
        for r in rollup.metric(name, ["k"], "month").collect():
            got[str(r.period)[:7] if r.period else None, r.k][name] = r[name]
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert tuple(row.values()) == pytest.approx(want[key])
    plan = rollup.metric("mean_v", [], "year")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date_day:date,sum__v:bigint,count__v:bigint>" in plan  # the states, not the fact
    with pytest.raises(KeyError):
        rollup.metric("none")
    with pytest.raises(KeyError):
        rollup.metric("sum_w", ["other"])
    with pytest.raises(ValueError):
        rollup.metric("sum_w", [], "hour")


def test_sums_and_distincts_equal_brute_force_without_expand(spark):
    rng = random.Random(8)
    # one key holds most rows; nulls in key, counted columns and values
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else rng.choice("xyz"), rng.choice([1, 2, 3, None]), rng.choice(["p", "q", None]), rng.choice([1, 5, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, a int, b string, v int")
    got = sums_and_distincts(df, ["g"], {"total": F.col("v")}, {"n_a": "a", "n_b": "b"})
    groups = defaultdict(list)
    for g, *rest in rows:
        groups[g].append(rest)
    want = {g: (sum(v for *_, v in at if v), len({a for a, *_ in at} - {None}), len({b for _, b, _ in at} - {None})) for g, at in groups.items()}
    assert {r.g: (r.total, r.n_a, r.n_b) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert got.limit(0).count() == 0 and sums_and_distincts(df.limit(0), ["g"], {"total": F.col("v")}, {"n_a": "a"}).count() == 0


def test_landing_status_comes_from_the_audit(spark, tmp):
    t = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id int, x string")

    def broken(_):
        raise OSError("source is down")

    land_sources(spark, tmp, {"one": lambda _: {"t": t, "one.u": t.limit(1)}}, {"t": ["id"]}, {"one": "2024-01-01 00:00:00"})
    land_sources(spark, tmp, {"one": lambda _: {"t": t.union(t)}}, {"t": ["id"]}, {"one": "2024-01-02 00:00:00"})
    with pytest.raises(OSError):
        land_sources(spark, tmp, {"one": broken})
    r = landed_status(spark, tmp, ["one"]).collect()[0]
    assert (r.source, r.table_count, r.total_rows, r.null_keys, str(r.last_sync)) == ("one", 1, 6, 2, "2024-01-02 00:00:00")
