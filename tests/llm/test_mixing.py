import hashlib
import math

from pyspark.sql import functions as F

from tidewater.llm import mixing
from tidewater.llm.queries import MIX_SEED, MIX_WEIGHTS
from tidewater.verify.compare import compare, duckdb_connection
from tests.conftest import SF_SMALL


def draw(seed, key, rate):
    """Inverse Poisson by the plain sum."""
    u = int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and p > 0:
        k += 1
        p *= rate / k
        total += p
    return k if rate > 0 else 0


def test_counts_match_brute_force(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "b").otherwise("c").alias("source"))
    weights = {"hot": 0.1, "b": 0.5, "absent": 0.2}
    named, rest = mixing.rates(docs, weights, 1.5)
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert set(named) == {"hot", "b"}
    assert math.isclose(named["hot"] * n["hot"] / (named["b"] * n["b"]), 0.2) and math.isclose(named["hot"] * n["hot"] + named["b"] * n["b"] + rest * n["c"], 6000)
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, weights, 11, 1.5).groupBy("doc_id").count().collect()}
    for r in docs.collect():
        assert got.get(r.doc_id, 0) == draw(11, r.doc_id, named.get(r.source, rest))
    by = {r.source: r["count"] for r in mixing.mix(docs, weights, 11, 1.5).groupBy("source").count().collect()}
    assert abs(by["hot"] / 6000 - 0.125) < 0.02 and abs(by["b"] / 6000 - 0.625) < 0.03


def test_large_rates_have_no_cap():
    steps = mixing.poisson_steps(900.0)
    assert len(steps) > 1100 and all(a <= b for a, b in zip(steps, steps[1:])) and abs(steps[900] - 0.5) < 0.02


def test_matches_oracle(spark):
    con = duckdb_connection(SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    result = compare(mixing.mix(docs, MIX_WEIGHTS, MIX_SEED, copy="copy"), con, mixing.oracle(MIX_WEIGHTS, MIX_SEED))
    assert result["values_match"], result


def test_shuffled_globally_and_native(spark):
    docs = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    out = mixing.mix(docs, {"s": 1.0}, 5)
    order = [r.doc_id for r in out.collect()]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.1
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("copy").withColumn("__x", F.lit(1))
    out = mixing.mix(docs, {"a": 0.5}, 3, size=4.0)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(2) % 2 == 0  # the two equal rows draw alike
    assert mixing.mix(docs.filter(F.lit(False)), {"a": 0.5}, 3).count() == 0
    assert mixing.mix(docs, {"a": 0.0}, 3, size=5.0).filter("source = 'a'").count() == 0
    assert mixing.mix(docs, {}, 3).columns == docs.columns


def test_clashing_columns(spark):
    """Columns named like the helpers come back as they were; one named like the copy's number is replaced."""
    docs = spark.range(50).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("u").alias("__MIX_u"), F.lit(-1).alias("__mix_n"),
        F.lit("c").alias("__mix_copy"), F.lit(7).alias("__mix__order"), F.lit("old").alias("Copy"))
    plain = mixing.mix(docs.select("doc_id", "source"), {"s": 1.0}, 5, 3.0, copy="copy").collect()
    out = mixing.mix(docs, {"s": 1.0}, 5, 3.0, copy="copy")
    assert out.columns == ["doc_id", "source", "__MIX_u", "__mix_n", "__mix_copy", "__mix__order", "copy"]
    rows = out.collect()
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((r["doc_id"], r["copy"]) for r in plain)
    assert {tuple(r)[2:6] for r in rows} == {("u", -1, "c", 7)}
    assert mixing.mix(docs, {"s": 1.0}, 5).columns == docs.columns
