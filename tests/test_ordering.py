import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.operators import order_statistics, with_positions


def order():
    return [F.asc_nulls_last("k"), F.asc("i")]


@pytest.fixture(scope="module")
def skewed():
    """A key with 40 % of the rows, nulls, and repeated rows."""
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(50) if rng.random() < 0.95 else None, i // 2, Decimal(rng.randrange(10**6)) / 100) for i in range(3000)]
    return rows + [(1, 1, None)]


def test_positions_and_running_totals(spark, skewed):
    df = spark.createDataFrame(skewed, "k int, i int, v decimal(18,2)").repartition(5)
    got = with_positions(df, [*order(), F.asc_nulls_last("v")], "pos", {"total": "v"}, partitions=13).collect()
    want = sorted(skewed, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))
    assert sorted(r.pos for r in got) == list(range(1, len(want) + 1))
    total = Decimal(0)
    for r, (k, i, v) in zip(sorted(got, key=lambda r: r.pos), want):
        total += v or 0
        assert (r.k, r.i, r.v, r.total) == (k, i, v, total)


def test_no_task_holds_the_hot_key(spark):
    """Equal rows alone: they still spread over the partitions."""
    placed = with_positions(spark.range(4000).select(F.lit(1).alias("k")), [F.asc("k")], "pos", partitions=8)
    assert placed.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 4000, 4000)
    from tidewater.operators.ordering import _PART, _SALT

    ranged = spark.range(4000).withColumn("k", F.lit(1)).withColumn(_SALT, F.rand(29)).repartitionByRange(8, "k", _SALT)
    sizes = [r["count"] for r in ranged.withColumn(_PART, F.spark_partition_id()).groupBy(_PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200


def test_only_partition_sums_meet_in_one_task(spark, skewed):
    df = spark.createDataFrame(skewed, "k int, i int, v decimal(18,2)")
    plan = with_positions(df, order(), "pos", {"total": "v"})._jdf.queryExecution().executedPlan().toString()
    for at in [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]:
        below = "\n".join(plan.splitlines()[at + 1 : at + 4])
        assert "HashAggregate(keys=[__part" in below  # one row a partition


def test_empty(spark):
    none = spark.createDataFrame([], "k int, i int, v decimal(18,2)")
    assert with_positions(none, order(), "pos", {"total": "v"}).count() == 0
    assert order_statistics(none, ["k"], "v", {"m": 0.5}).count() == 0


def test_percentiles_are_exact(spark, skewed):
    df = spark.createDataFrame([*skewed, (99, 0, None), (99, 1, None), (98, 0, Decimal(5))], "k int, i int, v decimal(18,2)").repartition(6)
    shares = {"low": 0.0, "q1": 0.25, "p33": 1 / 3, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r.k: r for r in order_statistics(df, ["k"], "v", shares, partitions=9).collect()}
    values = {}
    for k, _, v in skewed + [(98, 0, Decimal(5))]:
        if v is not None:
            values.setdefault(k, []).append(float(v))
    assert got.keys() == values.keys() | {99}
    assert got[99].n == 0 and got[99].median is None
    for k, vs in values.items():
        assert got[k].n == len(vs) and got[k].median == pytest.approx(statistics.median(vs))
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, share))


def test_percentiles_without_groups_and_without_value_maps(spark):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    stats = order_statistics(lines, [], "l_extendedprice", {"median": 0.5})
    assert "percentile" not in stats._jdf.queryExecution().executedPlan().toString()
    assert stats.first().median == pytest.approx(lines.agg(F.percentile("l_extendedprice", 0.5)).first()[0])
