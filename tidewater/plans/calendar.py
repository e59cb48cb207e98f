"""Generated dimensions: calendar, hours of the day, time spine.

Both are generated in one task from a single ``sequence`` (1,826 and 24
rows): statically bounded, so joins against them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.dates import day_of_week_sunday0, iso_year_week
from tidewater.plans.core import Warehouse, model

# --- fixed values -----------------------------------------------------------
CALENDAR_START = "2022-01-01"
CALENDAR_END = "2026-12-31"
CALENDAR_ROWS = 1826
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}
FISCAL_START_MONTH = 7
# (first hour, last hour, period, sort order); anything else is Overnight / 5
TIME_PERIODS = [(7, 9, "AM Peak", 1), (10, 15, "Midday", 2), (16, 19, "PM Peak", 3), (20, 22, "Evening", 4)]
TIME_PERIOD_OTHER = ("Overnight", 5)
PEAK_HOURS = (7, 19)
# ---------------------------------------------------------------------------


def date_spine(spark, start: str, end: str, name: str = "date_day") -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias(name)
    )


def _season(m):
    expr = None
    for month, label in SEASONS.items():
        cond = m == F.lit(month)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


@model("dim_date", layer="table")
def dim_date(w: Warehouse) -> DataFrame:
    d = F.col("date_day")
    m = F.month(d)
    dow = day_of_week_sunday0(d)
    return date_spine(w.spark, CALENDAR_START, CALENDAR_END).select(
        d,
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        F.year(d).alias("year_number"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_label"),
        m.alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short_name"),
        F.date_format(d, "yyyyMM").cast("int").alias("year_month_key"),
        F.weekofyear(d).alias("week_of_year"),
        iso_year_week(d).alias("year_week_key"),
        F.date_trunc("WEEK", d).cast("date").alias("week_start_date"),
        F.dayofmonth(d).alias("day_of_month"),
        dow.alias("day_of_week_number"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.date_format(d, "E").alias("day_of_week_short"),
        F.dayofyear(d).alias("day_of_year"),
        dow.isin(0, 6).alias("is_weekend"),
        (~dow.isin(0, 6)).alias("is_weekday"),
        _season(m).alias("season"),
        F.when(m >= FISCAL_START_MONTH, F.year(d) + 1).otherwise(F.year(d)).alias("fiscal_year"),
        F.when(m >= FISCAL_START_MONTH, m - (FISCAL_START_MONTH - 1))
        .otherwise(m + (13 - FISCAL_START_MONTH))
        .alias("fiscal_month_number"),
    )


def _period(h, idx: int):
    expr = None
    for lo, hi, label, order in TIME_PERIODS:
        val = F.lit(label) if idx == 0 else F.lit(order)
        cond = h.between(lo, hi)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(TIME_PERIOD_OTHER[idx]))


@model("dim_time_of_day", layer="table")
def dim_time_of_day(w: Warehouse) -> DataFrame:
    h = F.col("id")
    hs = h.cast("string")
    ampm = (
        F.when(h == 0, F.lit("12:00 AM"))
        .when(h < 12, F.concat(hs, F.lit(":00 AM")))
        .when(h == 12, F.lit("12:00 PM"))
        .otherwise(F.concat((h - 12).cast("string"), F.lit(":00 PM")))
    )
    return w.spark.range(0, 24, 1, numPartitions=1).select(
        h.alias("hour_of_day"),
        _period(h, 0).alias("time_period"),
        _period(h, 1).alias("time_period_sort_order"),
        h.between(*PEAK_HOURS).alias("is_peak_hour"),
        F.concat(F.lpad(hs, 2, "0"), F.lit(":00")).alias("hour_label"),
        ampm.alias("hour_label_ampm"),
    )


@model("metricflow_time_spine", layer="table")
def time_spine(w: Warehouse) -> DataFrame:
    return w.ref("dim_date").select("date_day")
