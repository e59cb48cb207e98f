"""Equi-join helpers (JN-1..3, JN-5..10).

Broadcast policy: a side is hinted for broadcast only when its size has a
*static* bound the caller can prove (a generated calendar, the 24 hours of
a day).  Dimensions derived from data (routes, lanes, users) are joined
without a hint; AQE measures the real size of the finished shuffle stage and
switches to a broadcast hash join only below
``spark.sql.adaptive.autoBroadcastJoinThreshold``, otherwise it keeps the
sort-merge join (with skew splitting).  Nothing is broadcast on a guess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str] | Column,
    how: str = "left",
    static_rows: int | None = None,
) -> DataFrame:
    """Join a fact to a dimension.

    ``static_rows`` is the proven upper bound of ``dim``'s row count, when
    one exists; only then is the dimension hinted for broadcast.
    """
    if static_rows is not None:
        if static_rows > 100_000:
            raise ValueError(f"{static_rows} rows are too many for a broadcast; leave static_rows out")
        dim = F.broadcast(dim)
    return fact.join(dim, on=on, how=how)


def keep_unmatched(
    base: DataFrame,
    matched: DataFrame,
    keys: Sequence[str],
    flag: str,
    default: bool = False,
) -> DataFrame:
    """Left join ``matched`` back onto ``base``; missing flag -> ``default`` (JN-5)."""
    out = base.join(matched, on=list(keys), how="left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(default)))


def outer_combine(
    a: DataFrame,
    b: DataFrame,
    key: str,
    zero_fill: Sequence[str],
) -> DataFrame:
    """Full outer join of two aggregates on ``key``; measures default to 0 (JN-7)."""
    out = a.join(b, on=key, how="full_outer")
    for c in zero_fill:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def spine_join(parts: Sequence[DataFrame], key: str, zero_fill: Sequence[str]) -> DataFrame:
    """Union of all keys (distinct), then a left join of every part (JN-8, SET-1).

    Each part is already aggregated to one row per ``key``.
    """
    spine = None
    for p in parts:
        keys = p.select(key)
        spine = keys if spine is None else spine.union(keys)
    out = spine.distinct()
    for p in parts:
        out = out.join(p, on=key, how="left")
    for c in zero_fill:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def with_group_total(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """Add ``sum(value)`` per group without collapsing rows (WIN-3).

    Written as aggregate + null-safe join back instead of a window: the
    aggregate is combined map-side, so a key holding a third of the rows
    never lands whole in one sort; the join back is broadcast by AQE when
    the totals are small and skew-split otherwise.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
    t = totals.alias("_t")
    d = df.alias("_d")
    cond = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in keys]
    return d.join(t, on=cond, how="left").select("_d.*", F.col(f"_t.{name}"))
