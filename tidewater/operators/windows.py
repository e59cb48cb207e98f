"""Window-function operators (WIN-1..8).

Row-number filters (``dedup_latest``, ``top_n_per_group``) compile to a
partial + final ``WindowGroupLimit``: every map task keeps only its local
top rows per key before the shuffle, so a key holding a third of all rows
ships a handful of rows, not a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _cols(cols: Sequence[ColumnOrName]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dedup_latest(
    df: DataFrame,
    keys: Sequence[ColumnOrName],
    order: Sequence[Column],
    rank_col: str = "_rn",
) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (WIN-1, WIN-2).

    ``order`` must end in columns that make it total (a row id) so the
    survivor is deterministic; e.g. ``[col('ts').desc_nulls_last(),
    col('_row_id').asc()]``.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) == 1).drop(rank_col)


def top_n_per_group(
    df: DataFrame,
    group: Sequence[ColumnOrName],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Rows ranked ``1..n`` per group by ``row_number`` (WIN-5)."""
    w = Window.partitionBy(*_cols(group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def add_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Global ``row_number() over (order by ...)`` (WIN-4).

    Runs in one partition: call it only on aggregated output whose size is
    bounded by a dimension (boroughs, routes, corridors).
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def period_over_period(
    df: DataFrame,
    partition: Sequence[ColumnOrName],
    order: Sequence[Column],
    value: str,
    prior_name: str,
    change_name: str,
    pct_name: str,
    change_digits: int = 2,
    pct_digits: int = 1,
) -> DataFrame:
    """LAG of ``value`` plus absolute and percentage change (WIN-6).

    The lag is computed once and reused; the percentage is guarded by
    ``nullif(prior, 0)``.
    """
    from tidewater.functions.dates import round_half

    w = Window.partitionBy(*_cols(partition)).orderBy(*order)
    prior = F.lag(F.col(value)).over(w)
    out = df.withColumn(prior_name, prior)
    diff = F.col(value) - F.col(prior_name)
    return out.withColumn(change_name, round_half(diff, change_digits)).withColumn(
        pct_name, round_half(diff / F.nullif(F.col(prior_name), F.lit(0.0)) * F.lit(100.0), pct_digits)
    )


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Cumulative sum, ``rows between unbounded preceding and current row`` (WIN-7).

    One partition: used on per-day output whose size is bounded by the
    calendar.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.col(value)).over(w))
