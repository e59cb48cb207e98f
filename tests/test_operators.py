"""Relational operators on small frames, plus brute-force checks."""

import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import (
    add_rank,
    containment_pairs,
    dedup_latest,
    first_containment_match,
    outer_combine,
    period_over_period,
    pivot_max,
    running_total,
    share_of_group,
    spine_join,
    top_n_per_group,
    weighted_avg,
    weighted_sum,
    with_group_total,
)

c = F.col


def test_dedup_latest_nulls_last_and_tiebreak(spark):
    df = spark.createDataFrame(
        [("k", None, "a"), ("k", 5, "b"), ("k", 5, "a"), ("j", None, "z")], "k string, ts int, id string"
    )
    out = dedup_latest(df, ["k"], [c("ts").desc_nulls_last(), c("id").asc()])
    assert sorted((r.k, r.ts, r.id) for r in out.collect()) == [("j", None, "z"), ("k", 5, "a")]


def test_dedup_plan_prunes_before_shuffle(spark):
    df = spark.range(1000).select((c("id") % 7).alias("k"), c("id"))
    plan = dedup_latest(df, ["k"], [c("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_n_per_group(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(5)], "g string, v int")
    out = top_n_per_group(df, ["g"], [c("v").desc()], 2, "rk")
    assert sorted((r.g, r.v, r.rk) for r in out.collect()) == [("a", 3, 2), ("a", 4, 1), ("b", 3, 2), ("b", 4, 1)]


def test_pivot_max_and_share(spark):
    df = spark.createDataFrame([("r", "Peak", 10.0), ("r", "Off", 8.0), ("s", "Off", 5.0)], "k string, cls string, v double")
    p = pivot_max(df, ["k"], {"peak": (c("cls") == "Peak", "v"), "off": (c("cls") == "Off", "v")})
    assert sorted((r.k, r.peak, r.off) for r in p.collect()) == [("r", 10.0, 8.0), ("s", None, 5.0)]
    sh = share_of_group(df, ["k"], ["cls"], "n", "pct")
    assert sorted((r.k, r.cls, r.n, r.pct) for r in sh.collect()) == [("r", "Off", 1, 50.0), ("r", "Peak", 1, 50.0), ("s", "Off", 1, 100.0)]


def test_period_over_period_and_running_total(spark):
    df = spark.createDataFrame([("b", 1, 10.0), ("b", 2, 12.0), ("b", 3, 0.0), ("b", 4, 3.0)], "g string, m int, v double")
    out = period_over_period(df, ["g"], [c("m").asc()], "v", "prior", "chg", "pct").orderBy("m").collect()
    assert [r.prior for r in out] == [None, 10.0, 12.0, 0.0]
    assert [r.chg for r in out] == [None, 2.0, -12.0, 3.0]
    assert [r.pct for r in out] == [None, 20.0, -100.0, None]  # nullif guard on a zero prior
    rt = running_total(df, [c("m").asc()], "v", "cum").orderBy("m").collect()
    assert [r.cum for r in rt] == [10.0, 22.0, 22.0, 25.0]


def test_spine_and_outer_combine(spark):
    a = spark.createDataFrame([(1, 5)], "d int, x int")
    b = spark.createDataFrame([(2, 7)], "d int, y int")
    s = spine_join([a, b], "d", ["x", "y"]).orderBy("d").collect()
    assert [(r.d, r.x, r.y) for r in s] == [(1, 5, 0), (2, 0, 7)]
    o = outer_combine(a, b, "d", ["x", "y"]).orderBy("d").collect()
    assert [(r.d, r.x, r.y) for r in o] == [(1, 5, 0), (2, 0, 7)]


def test_group_total_null_safe(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v long")
    out = with_group_total(df, ["k"], "v", "tot").collect()
    assert sorted((r.k or "", r.v, r.tot) for r in out) == [("", 3, 7), ("", 4, 7), ("a", 1, 3), ("a", 2, 3)]


def test_add_rank_orders_globally(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", 3.0), ("z", None)], "k string, v double")
    out = add_rank(df, [c("v").desc_nulls_last()], "rk").collect()
    assert {r.k: r.rk for r in out} == {"y": 1, "x": 2, "z": 3}


def test_weighted_equals_fan_out(spark):
    fact = spark.createDataFrame([("s1", 10.0, 3), ("s1", None, 4), ("s2", 20.0, 5)], "seg string, v double, t int")
    match = spark.createDataFrame([("s1", "L"), ("s1", "L"), ("s1", "L"), ("s2", "L")], "seg string, lane string")
    fan = fact.join(match, "seg").groupBy("lane").agg(F.avg("v").alias("a"), F.sum("t").alias("s")).first()
    w = match.groupBy("seg", "lane").agg(F.count(F.lit(1)).alias("_w"))
    wt = fact.join(w, "seg").groupBy("lane").agg(weighted_avg("v", "_w").alias("a"), weighted_sum("t", "_w").alias("s")).first()
    assert (fan.a, fan.s) == (wt.a, wt.s)


def _like_contains(text, pat):
    rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pat.lower())
    return re.search(rx, text.lower(), re.S) is not None


def test_containment_wildcards_and_backslash(spark):
    texts = spark.createDataFrame([("NATION_12 AVE",), ("a\\b st",), ("x",), ("",)], "t string")
    pats = spark.createDataFrame([("nation_1",), ("N%AVE",), ("\\B",), ("",), ("__",), ("zz",)], "p string")
    got = {(r.text, r.pattern) for r in containment_pairs(texts, "t", pats, "p").collect()}
    want = {(t, p) for t, p in itertools.product(["NATION_12 AVE", "a\\b st", "x", ""],
                                                 ["nation_1", "N%AVE", "\\B", "", "__", "zz"]) if _like_contains(t, p)}
    assert got == want


ALPHABET = "ab_%"


@settings(max_examples=15, deadline=None)
@given(
    texts=st.lists(st.text(alphabet="abAB ", min_size=0, max_size=6), min_size=1, max_size=6),
    pats=st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=4), min_size=1, max_size=6),
)
def test_containment_matches_brute_force(spark, texts, pats):
    tdf = spark.createDataFrame([(t,) for t in texts], "t string")
    pdf = spark.createDataFrame([(p,) for p in pats], "p string")
    got = {(r.text, r.pattern) for r in containment_pairs(tdf, "t", pdf, "p").collect()}
    want = {(t, p) for t in set(texts) for p in set(pats) if _like_contains(t, p)}
    assert got == want


def test_first_containment_match_both_directions(spark):
    groups = spark.createDataFrame(
        [("g1", "Main St", "Elm Ave"), ("g2", "BROADWAY", None), ("g3", "Nowhere", "Void")],
        "g string, a string, b string",
    )
    targets = spark.createDataFrame(
        [("elm", "2", "x"), ("elm", "1", "y"), ("Broadway Av", "9", "z"), ("st", "5", "w")],
        "street string, sid string, kind string",
    )
    out = first_containment_match(groups, ["g"], ["a", "b"], targets, "street", ["sid", "kind"]).collect()
    got = {r.g: (r.street, r.sid) for r in out}
    # g1: 'elm' in 'Elm Ave' and 'st' in 'Main St' -> min street 'elm', first lane sid '1'
    # g2: 'BROADWAY' is contained in 'Broadway Av'
    assert got == {"g1": ("elm", "1"), "g2": ("Broadway Av", "9")}
