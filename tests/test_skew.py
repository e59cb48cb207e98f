"""A key holding a third of all rows: results stay exact and the plans keep
their map-side reduction (partial aggregates / partial window limits)."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewater.operators import dedup_latest, top_n_per_group, with_group_total

N = 30_000


def _skewed(spark):
    # key 0 holds ~40% of the rows, the rest spread over 500 keys
    return spark.range(N).select(
        F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("k"),
        (F.col("id") * 7919 % 1000).alias("v"),
        F.col("id"),
    ).repartition(16)


def _rows():
    out = []
    for i in range(N):
        k = 0 if i % 5 < 2 else i % 500 + 1
        out.append((k, i * 7919 % 1000, i))
    return out


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_dedup_and_topn(spark):
    df = _skewed(spark)
    latest = dedup_latest(df, ["k"], [F.col("v").desc(), F.col("id").asc()])
    want = {}
    for k, v, i in _rows():
        if k not in want or (v, -i) > (want[k][0], -want[k][1]):
            want[k] = (v, i)
    assert {r.k: (r.v, r.id) for r in latest.collect()} == want
    assert "WindowGroupLimit" in _plan(latest) and "Partial" in _plan(latest)

    top = top_n_per_group(df, ["k"], [F.col("v").desc(), F.col("id").asc()], 3, "rk")
    got = Counter(r.k for r in top.collect())
    assert got[0] == 3 and all(c == 3 for c in got.values())


def test_hot_key_group_total_and_distinct(spark):
    df = _skewed(spark)
    totals = defaultdict(int)
    distinct = defaultdict(set)
    for k, v, _ in _rows():
        totals[k] += v
        distinct[k].add(v)
    out = with_group_total(df, ["k"], "v", "tot")
    assert out.count() == N
    assert {r.k: r.tot for r in out.select("k", "tot").distinct().collect()} == dict(totals)
    agg = df.groupBy("k").agg(F.count_distinct("v").alias("d"), F.sum("v").alias("s"))
    assert {r.k: r.d for r in agg.collect()} == {k: len(s) for k, s in distinct.items()}
    plan = _plan(agg)
    assert "HashAggregate" in plan and "partial_" in plan  # combined before the shuffle
