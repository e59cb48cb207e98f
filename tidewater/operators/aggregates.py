"""Aggregation operators (AG-1..19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.dates import round_half


def count_where(pred: Column) -> Column:
    """``count(case when pred then 1 end)`` / ``count(*) filter (where pred)`` (AG-3..5)."""
    return F.count_if(pred)


def avg_where(value: Column, pred: Column) -> Column:
    """``avg(case when pred then value end)`` (AG-6)."""
    return F.avg(F.when(pred, value))


def pct_where(pred: Column, digits: int = 1) -> Column:
    """``round(count_if(pred) * 100.0 / nullif(count(*), 0), digits)`` (AG-8)."""
    share = F.count_if(pred) * F.lit(100.0) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return round_half(share, digits)


def pivot_max(
    df: DataFrame,
    keys: Sequence[str],
    outputs: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """Conditional pivot ``max(case when cond then measure end)`` (AG-7).

    ``outputs`` maps an output column to ``(condition, measure column)``.
    One aggregation, no value-discovery job (unlike ``GroupedData.pivot``
    without a value list).
    """
    aggs = [F.max(F.when(cond, F.col(measure))).alias(name) for name, (cond, measure) in outputs.items()]
    return df.groupBy(*keys).agg(*aggs)


def share_of_group(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    count_name: str = "record_count",
    pct_name: str = "pct_of_group",
    digits: int | None = 1,
) -> DataFrame:
    """``count(*) * 100.0 / sum(count(*)) over (partition by group)`` (AG-9, WIN-8).

    The window runs over the aggregated rows only (one per group x key).
    """
    counted = df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias(count_name))
    total = F.sum(F.col(count_name)).over(Window.partitionBy(*group))
    pct = F.col(count_name) * F.lit(100.0) / total
    return counted.withColumn(pct_name, round_half(pct, digits) if digits is not None else pct)


def distribution_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Mean, sample stddev and exact interpolated percentiles per group (AG-10, AG-11).

    ``extra`` aggregates are computed in the same pass.

    ``percentile`` is exact (same as ``percentile_cont``) and merges
    partial value-count maps, so it is combined map-side.  A group's map
    holds one entry per *distinct* value, so pass an aggregated grain: the
    reports call it on route x day rows, whose count is bounded by routes x
    calendar days however many raw observations feed them.
    """
    names = list(quantiles)
    qs = [float(quantiles[n]) for n in names]
    agg = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_stddev"),
        F.percentile(F.col(value), F.array(*[F.lit(q) for q in qs])).alias("_pcts"),
        *extra,
    )
    for i, n in enumerate(names):
        agg = agg.withColumn(n, F.col("_pcts")[i])
    return agg.drop("_pcts")


def weighted_avg(value: str, weight: str) -> Column:
    """``avg`` over rows repeated ``weight`` times, without repeating them.

    Equals ``avg(value)`` over the fanned-out rows: NULL values are skipped
    and an all-NULL group gives NULL.
    """
    v, w = F.col(value), F.col(weight)
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def weighted_sum(value: str, weight: str) -> Column:
    """``sum`` over rows repeated ``weight`` times (NULL if all NULL)."""
    return F.sum(F.col(value) * F.col(weight))


def zero_safe_diff(a: str, b: str) -> Column:
    """``coalesce(a, 0) - coalesce(b, 0)`` (AG-19)."""
    return F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))


def sums_and_distincts(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    distincts: Mapping[str, str],
) -> DataFrame:
    """Sums and several exact distinct counts by ``keys`` without an Expand (AG-2).

    Rows are first added up by keys and counted columns (map-side, and spread
    over all of them, so a hot key is not one task's).  What is left, one row
    per combination, is dealt by ``keys`` once: inside a partition the first
    row of each (keys, value) pair counts for its value.  NULL keys are one group, NULL
    values are not counted.
    """
    counted = list(dict.fromkeys(distincts.values()))
    rows = df.groupBy(*keys, *counted).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    rows = rows.repartition(*keys)
    for name, column in distincts.items():
        first = F.row_number().over(Window.partitionBy(*keys, column).orderBy(*[F.col(c) for c in counted if c != column] or [F.lit(1)]))
        rows = rows.withColumn(f"_first_{name}", (first == 1) & F.col(column).isNotNull())
    return rows.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums], *[F.count_if(f"_first_{name}").alias(name) for name in distincts]
    )
