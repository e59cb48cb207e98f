"""Date / time expressions with the reference engine's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c: ColumnOrName, digits: int) -> Column:
    """``round(x, n)`` as ``round(x * 10^n) / 10^n`` (FN-16).

    Spark rounds the decimal text of the double (1.005 -> 1.01); the
    reference rounds the scaled binary value (1.005 -> 1.0).  Scaling first
    reproduces the latter.
    """
    scale = float(10**digits)
    return F.round(_col(c) * F.lit(scale)) / F.lit(scale)


def trunc_day(c: ColumnOrName) -> Column:
    """``date_trunc('day', ts)`` keeping TIMESTAMP_NTZ."""
    return F.date_trunc("DAY", _col(c)).cast("timestamp_ntz")


def trunc_week_date(c: ColumnOrName) -> Column:
    """Monday of the ISO week as DATE."""
    return F.date_trunc("WEEK", _col(c)).cast("date")


def date_diff_hours(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Hour boundaries crossed from ``start`` to ``end`` (10:59 -> 11:01 is 1)."""
    a = F.date_trunc("HOUR", _col(start))
    b = F.date_trunc("HOUR", _col(end))
    return ((F.unix_micros(b) - F.unix_micros(a)) / F.lit(3_600_000_000)).cast("long")


def date_diff_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Day boundaries crossed (23:59 -> 00:01 is 1)."""
    return F.datediff(_col(end).cast("date"), _col(start).cast("date")).cast("long")


def day_of_week_sunday0(c: ColumnOrName) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_col(c)) - F.lit(1)


def iso_year_week(c: ColumnOrName) -> Column:
    """ISO year * 100 + ISO week (2024-12-30 -> 202501)."""
    d = _col(c)
    return F.extract(F.lit("YEAROFWEEK"), d) * F.lit(100) + F.weekofyear(d)


def epoch_to_ts(c: ColumnOrName) -> Column:
    """Epoch seconds (int or fractional) -> TIMESTAMP, microsecond exact."""
    return F.timestamp_seconds(_col(c))
