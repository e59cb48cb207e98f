"""Rule-table CASE expressions: prefix category, grade, range bucket.

The rule tables below are fixed values that the reports must reproduce
exactly; each helper turns a table into a ``when`` chain evaluated in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values -----------------------------------------------------------
# Route id prefix -> borough, checked in this order; anything else 'Unknown'.
BOROUGH_PREFIXES = [
    ("Q", "Queens"),
    ("BX", "Bronx"),
    ("BK", "Brooklyn"),
    ("B", "Brooklyn"),
    ("M", "Manhattan"),
    ("S", "Staten Island"),
]
BOROUGH_DEFAULT = "Unknown"

# Reliability grade by average speed (mph, lower bound inclusive); else 'F'.
GRADE_THRESHOLDS = [(12, "A"), (9, "B"), (6, "C"), (4, "D")]
GRADE_DEFAULT = "F"

# Speed histogram: (exclusive upper edge, label); the last bucket is open.
SPEED_BUCKETS = [
    (3, "0-3 mph (Very Slow)"),
    (6, "3-6 mph (Slow)"),
    (9, "6-9 mph (Below Average)"),
    (12, "9-12 mph (Average)"),
    (15, "12-15 mph (Above Average)"),
    (20, "15-20 mph (Fast)"),
]
SPEED_BUCKET_LAST = "20+ mph (Very Fast)"
# ---------------------------------------------------------------------------


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_category(
    c: ColumnOrName,
    rules: Sequence[tuple[str, str]] = BOROUGH_PREFIXES,
    default: str = BOROUGH_DEFAULT,
) -> Column:
    """First rule whose prefix matches ``upper(c)`` wins (order matters)."""
    up = F.upper(_col(c))
    expr = None
    for prefix, label in rules:
        cond = F.left(up, F.lit(len(prefix))) == F.lit(prefix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def grade(
    c: ColumnOrName,
    thresholds: Sequence[tuple[float, str]] = GRADE_THRESHOLDS,
    default: str = GRADE_DEFAULT,
) -> Column:
    """Descending ``>=`` thresholds; NULL falls through to ``default``."""
    x = _col(c)
    expr = None
    for bound, label in thresholds:
        cond = x >= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def bucketize(
    c: ColumnOrName,
    buckets: Sequence[tuple[float, str]] = SPEED_BUCKETS,
    last: str = SPEED_BUCKET_LAST,
) -> Column:
    """Half-open ``x < edge`` buckets; NULL lands in the last bucket."""
    x = _col(c)
    expr = None
    for edge, label in buckets:
        cond = x < F.lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(last))


def bucket_order(c: ColumnOrName, buckets: Sequence[tuple[float, str]] = SPEED_BUCKETS) -> Column:
    """1-based sort order of :func:`bucketize`'s bucket."""
    x = _col(c)
    expr = None
    for i, (edge, _) in enumerate(buckets, start=1):
        cond = x < F.lit(edge)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(buckets) + 1))


def two_class(flag: ColumnOrName, if_true: str, if_false: str) -> Column:
    """Boolean -> label; NULL takes the ``if_false`` label (PRJ-12)."""
    return F.when(_col(flag), F.lit(if_true)).otherwise(F.lit(if_false))
