"""Calendar periods as column expressions (UTC dates).

A period is identified by its first day (``period_start``).  ISO weeks start
on Monday; the ISO year of a week is the year of its Thursday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display values.
DAY_NAMES_MON_FIRST = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
COMPARISON_LABELS = {
    "daily": "vs yesterday",
    "weekly": "vs last week",
    "monthly": "vs last month",
    "yearly": "vs last year",
}


def period_start(date_col: Column, period: str) -> Column:
    if period == "daily":
        return date_col.cast("date")
    if period == "weekly":
        return F.trunc(date_col, "week")
    if period == "monthly":
        return F.trunc(date_col, "month")
    if period == "yearly":
        return F.trunc(date_col, "year")
    raise ValueError(f"unknown period type {period!r}")


def period_end(start: Column, period: str) -> Column:
    if period == "daily":
        return start
    if period == "weekly":
        return F.date_add(start, 6)
    if period == "monthly":
        return F.last_day(start)
    if period == "yearly":
        return F.date_add(F.add_months(start, 12), -1)
    raise ValueError(f"unknown period type {period!r}")


def previous_period_start(start: Column, period: str) -> Column:
    """First day of the period before: day-1, week-1 (wraps to week 52/53), month-1, year-1."""
    if period == "daily":
        return F.date_add(start, -1)
    if period == "weekly":
        return F.date_add(start, -7)
    if period == "monthly":
        return F.add_months(start, -1)
    if period == "yearly":
        return F.add_months(start, -12)
    raise ValueError(f"unknown period type {period!r}")


def iso_year(date_col: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date_col).cast("int")


def iso_weeks_in_year(year: Column) -> Column:
    """52 or 53: the ISO week number of December 28th."""
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def period_label(start: Column, period: str) -> Column:
    if period == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if period == "weekly":
        return F.format_string("%d-W%02d", iso_year(start), F.weekofyear(start))
    if period == "monthly":
        return F.date_format(start, "yyyy-MM")
    return F.date_format(start, "yyyy")
