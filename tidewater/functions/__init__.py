"""Column expressions (all JVM-side, codegen friendly; no Python UDFs)."""

from tidewater.functions.casts import try_cast_double, try_cast_int, try_cast_long, text_ts
from tidewater.functions.classify import (
    bucketize,
    bucket_order,
    grade,
    prefix_category,
    two_class,
    BOROUGH_PREFIXES,
    GRADE_THRESHOLDS,
    SPEED_BUCKETS,
)
from tidewater.functions.dates import (
    date_diff_days,
    date_diff_hours,
    day_of_week_sunday0,
    epoch_to_ts,
    iso_year_week,
    round_half,
    trunc_day,
    trunc_week_date,
)
from tidewater.functions.keys import md5_or_null, surrogate_key

__all__ = [
    "try_cast_double",
    "try_cast_int",
    "try_cast_long",
    "text_ts",
    "bucketize",
    "bucket_order",
    "grade",
    "prefix_category",
    "two_class",
    "BOROUGH_PREFIXES",
    "GRADE_THRESHOLDS",
    "SPEED_BUCKETS",
    "date_diff_days",
    "date_diff_hours",
    "day_of_week_sunday0",
    "epoch_to_ts",
    "iso_year_week",
    "round_half",
    "trunc_day",
    "trunc_week_date",
    "md5_or_null",
    "surrogate_key",
]
