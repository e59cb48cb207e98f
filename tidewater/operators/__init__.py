"""Reusable relational operators built from DataFrame primitives."""

from tidewater.operators.aggregates import (
    avg_where,
    count_where,
    distribution_stats,
    pct_where,
    pivot_max,
    share_of_group,
    sums_and_distincts,
    weighted_avg,
    weighted_sum,
    zero_safe_diff,
)
from tidewater.operators.fuzzy import containment_pairs, first_containment_match
from tidewater.operators.joins import (
    keep_unmatched,
    lookup_join,
    outer_combine,
    spine_join,
    with_group_total,
)
from tidewater.operators.ordering import order_statistics, with_positions
from tidewater.operators.windows import (
    add_rank,
    dedup_latest,
    period_over_period,
    running_total,
    top_n_per_group,
)

__all__ = [
    "avg_where",
    "count_where",
    "distribution_stats",
    "pct_where",
    "pivot_max",
    "share_of_group",
    "sums_and_distincts",
    "weighted_avg",
    "weighted_sum",
    "zero_safe_diff",
    "containment_pairs",
    "first_containment_match",
    "keep_unmatched",
    "lookup_join",
    "outer_combine",
    "spine_join",
    "with_group_total",
    "add_rank",
    "order_statistics",
    "with_positions",
    "dedup_latest",
    "period_over_period",
    "running_total",
    "top_n_per_group",
]
