"""Global positions, running totals and order statistics without one big task (WIN-4, WIN-7, AG-11).

The rows are range-partitioned by the wanted order, so all of one partition
come before all of the next.  Each partition numbers and sums its own rows; the
prefix sums of the partitions' counts and totals (one row a partition) are
added.  A random salt breaks ties between partitions, so equal rows, even a
third of all, spread; a null value adds nothing to a running total.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import warehouse_dir

_PART, _SALT = "__part", "__salt"


def _staged(df: DataFrame) -> DataFrame:
    """Write once to the shared folder: the partition numbers must not change between the two passes."""
    path = f"{warehouse_dir(df.sparkSession).rstrip('/')}/_ordered/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(
    df: DataFrame,
    order: Sequence[Column],
    position: str = "position",
    totals: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with its 1-based place in ``order`` and, for each ``totals`` entry
    ``name -> column``, the running total up to and with the row.

    Totals of whole numbers and decimals are exact; doubles depend on the order
    of addition, cast them to decimals first.
    """
    totals = totals or {}
    salted = df.withColumn(_SALT, F.rand(29))
    ranged = salted.repartitionByRange(*([partitions] if partitions else []), *order, F.col(_SALT))
    rows = _staged(ranged.withColumn(_PART, F.spark_partition_id()))
    sums = {name: F.coalesce(F.sum(column), F.lit(0)) for name, column in totals.items()}
    parts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"), *[s.alias(f"__{n}") for n, s in sums.items()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(_PART, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in parts.columns if c != _PART])
    inside = Window.partitionBy(_PART).orderBy(*order, _SALT)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.select(
        *[F.col(f"`{c}`") for c in df.columns], _PART, F.row_number().over(inside).cast("long").alias(position),
        *[F.coalesce(F.sum(column).over(upto), F.lit(0)).alias(name) for name, column in totals.items()])
    # one row a partition
    out = numbered.join(F.broadcast(bases), _PART)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col(position) + F.col("__n_base")).alias(position),
        *[(F.col(name) + F.col(f"__{name}_base")).alias(name) for name in totals])


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    shares: dict[str, float],
    partitions: int | None = None,
) -> DataFrame:
    """``group``, ``n`` and for each ``name -> share`` the interpolated percentile of ``value``, exact at any size.

    The rows are put in the order (group, value); a percentile is the mean of
    the rows at the two places around ``share * (n - 1)``, found by position.
    Nothing is gathered per group, so a group may hold any part of the rows.
    Null values do not count; a group of nulls alone has ``n`` 0 and null percentiles.
    """
    kept = df.select(*group, F.col(value).cast("double").alias("__v"))
    order = [*[F.col(g).asc_nulls_first() for g in group], F.col("__v").asc()]
    placed = with_positions(kept.where(F.col("__v").isNotNull()), order, "__at", partitions=partitions)
    ends = placed.groupBy(*group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    wanted = ends.select(*group, "__first", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(share)) * (F.col("n") - 1)).alias("x")) for name, share in shares.items()
    ])).alias("w")).select(*group, "n", F.col("w.name").alias("name"), (F.col("w.x") - F.floor("w.x")).alias("high"),
                           (F.col("__first") + F.floor("w.x")).alias("low_at"))
    sides = wanted.select(*group, "n", "name", F.explode(F.array(
        F.struct(F.col("low_at").alias("at"), (1 - F.col("high")).alias("weight")),
        F.struct((F.col("low_at") + 1).alias("at"), F.col("high").alias("weight")))).alias("s")).select(*group, "n", "name", "s.*")
    found = sides.where("weight > 0").join(placed.select(F.col("__at").alias("at"), "__v"), "at")
    out = found.groupBy(*group).agg(F.max("n").alias("n"), *[
        F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("__v"))).alias(name) for name in shares])
    # groups whose values are all null
    every = df.groupBy(*group).agg(F.lit(1).alias("__one")).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    same = reduce(Column.__and__, [F.col(f"__g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)]) if group else F.lit(True)
    if not group:
        return out
    return every.join(out, same, "left").select(
        *[F.col(f"__g{i}").alias(g) for i, g in enumerate(group)], F.coalesce("n", F.lit(0)).alias("n"), *shares)
