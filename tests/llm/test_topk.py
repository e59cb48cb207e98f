import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import topk
from tidewater.verify.compare import compare, duckdb_connection
from tests.conftest import SF_SMALL


def brute(rows, k, scale, is_query):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in {i: v for i, v in sorted(ok, reverse=True) if is_query(i)}.items():
        scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_matches_oracle_and_brute_force(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    con = duckdb_connection(SF_SMALL)
    found = topk.top_k(vectors, F.col("vec_id") % 100 == 0)
    result = compare(found, con, topk.oracle())
    assert result["values_match"], result
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10, 1024, lambda i: i % 100 == 0)


def test_blocks_ties_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(12)]) for i in range(300)]  # many ties
    rows += [(i, [1.0] * 12) for i in range(300, 340)] + [(7, rows[7][1])] * 3
    rows += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(1010, [2.0, 1.0]), (1020, [0.0] * 12), (1030, [1.0] * 20)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, score string")
    want = brute(rows, 5, 16, lambda i: i % 10 == 0)
    for size, asked in ((4096, 256), (37, 4)):
        got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=5, scale=16, rows=size, query_rows=asked)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert topk.top_k(frame.filter(F.lit(False)), F.col("vec_id") % 10 == 0).count() == 0
    few = topk.top_k(frame.filter("vec_id < 3"), F.col("vec_id") == 0, k=5, scale=16).collect()
    assert len(few) == 2


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**28 + i), float(3**17 - i)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") == 0, k=12, scale=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 1, lambda i: i == 0)


def test_bounds_leave_work_out():
    rng = np.random.default_rng(1)
    columns = np.floor(rng.normal(0, 100, (64, 5000)) * np.linspace(3, 0.05, 64)[:, None])
    queries, ids, seen = columns[:, :20].copy(), np.arange(5000), [0]
    for q, found, scores in topk.search_block(np.arange(20), queries, np.full(20, -np.inf), ids, columns, 10, seen):
        exact = queries[:, q] @ columns
        exact[q] = -np.inf
        assert scores.tolist() == np.sort(exact)[::-1][:10].tolist()
    assert seen[0] < 0.5 * 20 * 5000 * 64


def test_no_block_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (300, 8)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = topk.written
    monkeypatch.setattr(topk, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "1g")  # whatever fits the threshold by an estimate
    try:
        found = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=5, scale=64, rows=37, query_rows=4)
        got = sorted(tuple(r) for r in found.collect())
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
    assert got == brute(rows, 5, 64, lambda i: i % 10 == 0)
    assert len(plans) >= 3 and not [p for p in plans if "Broadcast" in p]
