"""Time columns, period keys and row filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import js_round


def _ts(value) -> F.Column:
    if isinstance(value, F.Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value).cast("timestamp_ntz")


def event_time(df: DataFrame) -> DataFrame:
    """``event_ts = coalesce(payload_ts, processing_ts)`` and its date."""
    ts = F.coalesce("payload_ts", "processing_ts")
    return df.withColumn("event_ts", ts).withColumn("event_date", F.to_date(ts))


def in_period(df: DataFrame, start, end) -> DataFrame:
    """rows with an ENERGY object and ``start <= event_ts < end``.

    The redundant ``event_date`` bounds let the scan prune partitions and row
    groups; the exact bound is on ``event_ts``.
    """
    start_ts, end_ts = _ts(start), _ts(end)
    return df.filter(
        F.col("has_energy")
        & (F.col("event_date") >= F.to_date(start_ts)) & (F.col("event_date") <= F.to_date(end_ts))
        & (F.col("event_ts") >= start_ts) & (F.col("event_ts") < end_ts)
    )


def with_period(df: DataFrame, period: str, date_col: str = "event_date") -> DataFrame:
    """``period_start``, ``period_end`` and ``period_label`` of each row's date."""
    start = cal.period_start(F.col(date_col), period)
    return (df.withColumn("period_start", start)
              .withColumn("period_end", cal.period_end(F.col("period_start"), period))
              .withColumn("period_label", cal.period_label(F.col("period_start"), period)))


def with_previous_period(df: DataFrame, period: str) -> DataFrame:
    """``prev_period_start`` (needs ``period_start``)."""
    return df.withColumn("prev_period_start", cal.previous_period_start(F.col("period_start"), period))


def filter_devices(df: DataFrame, device_id: str | None = None, device_type: str | None = None) -> DataFrame:
    """equality filters; an ENERGY object is required only when no type is given."""
    if device_id:
        df = df.filter(F.col("device_id") == device_id)
    if device_type:
        df = df.filter(F.col("device_type") == device_type)
    else:
        df = df.filter(F.col("has_energy"))
    return df


def recent_readings(df: DataFrame, as_of, hours: int = 24, limit: int | None = None) -> DataFrame:
    """the Power readings since ``as_of - hours``; with ``limit`` the newest so many, ascending.

    Without a limit this is a filter and a projection.  A limit is the
    caller's choice; sort+limit plans as TakeOrderedAndProject (per-partition
    top-k, then a bounded merge).
    """
    since = _ts(as_of) - F.make_dt_interval(hours=F.lit(hours))
    rows = (df.filter(F.col("power_w").isNotNull() & (F.col("processing_ts") >= since))
              .select(F.col("processing_ts").alias("timestamp"), F.col("power_w").alias("value"), "reading_id", "device_id"))
    if limit is None:
        return rows
    newest = rows.orderBy(F.col("timestamp").desc(), F.col("reading_id").desc()).limit(limit)
    return newest.orderBy("timestamp", "reading_id")


def data_sufficiency(df: DataFrame, as_of, days_required: float = 0) -> DataFrame:
    """age in days of the oldest Power reading, sufficiency flag and progress %.

    One global aggregate (partial per task, one-row final).
    """
    oldest = df.filter(F.col("power_w").isNotNull()).agg(F.min("processing_ts").alias("oldest"))
    secs = F.unix_micros(_ts(as_of).cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))
    age = F.coalesce(secs.cast("double") / F.lit(86_400_000_000.0), F.lit(0.0))
    req = F.lit(float(days_required))
    progress = F.lit(100.0) if days_required == 0 else F.least(F.lit(100.0), age / req * F.lit(100.0))
    return oldest.select(
        age.alias("days_available"),
        req.alias("days_required"),
        (age >= req).alias("is_sufficient"),
        js_round(progress, 1).alias("progress_percent"),
    )
