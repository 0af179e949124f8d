"""Consumption reports.

The daily counter ``today_kwh`` resets at midnight, so a day's consumption is
its maximum and an hour's consumption is the difference of consecutive hourly
maxima.  By default maxima are taken over all devices together (the
observable behaviour of a single-household report); ``by_device=True`` keeps
one series per device, which is the form to use for fleets.

Every report is computed for every period present in the input (one job, all
days / weeks / months / years), keyed by ``period_start``.  Row-level work is
a filter plus a partial aggregate; windows and calendar joins only ever see
the aggregated rows (at most 24 per device-day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import exact_sum, js_round
from ..functions.tariff import DEFAULT_TARIFF, Tariff, is_low_tariff_parts, reading_cost
from ..session import saved
from .periods import in_period


def _keys(by_device: bool) -> list:
    return ["device_id"] if by_device else []


# ---------------------------------------------------------------- W1 / W2
def meter_delta_keep_first(df: DataFrame, value: str, order_by, partition_by=(), out: str = "consumption") -> DataFrame:
    """Per-step consumption of a resetting counter.

    First row keeps its value; a drop (reset) counts the new value; otherwise
    ``max(0, cur - prev)``.  NULL counts as 0 (and then as the base 0).
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    cur = F.coalesce(F.col(value), F.lit(0.0))
    prev = F.lag(cur).over(w)
    delta = F.when(prev.isNull(), cur).when(cur < prev, cur).otherwise(F.greatest(F.lit(0.0), cur - prev))
    return df.withColumn(out, delta)


# ---------------------------------------------------------------- A1 / A2
def hourly_max(readings: DataFrame, by_device: bool = False) -> DataFrame:
    """A1: per date and UTC hour: ``max(today_kwh)`` and ``max(power_w)``."""
    return (readings.filter(F.col("has_energy"))
            .groupBy(*_keys(by_device), F.col("event_date").alias("period_start"),
                     F.hour("event_ts").alias("hour"))
            .agg(F.max("today_kwh").alias("max_energy"), F.max("power_w").alias("max_power")))


def daily_max(readings: DataFrame, by_device: bool = False) -> DataFrame:
    """A2: per date: max counter, max power, day of week (Sun=1), day of month, month."""
    agg = (readings.filter(F.col("has_energy"))
           .groupBy(*_keys(by_device), "event_date")
           .agg(F.max("today_kwh").alias("max_energy"), F.max("power_w").alias("max_power")))
    return agg.select(
        *_keys(by_device), F.col("event_date").alias("date"), "max_energy", "max_power",
        F.dayofweek("event_date").alias("day_of_week"),
        F.dayofmonth("event_date").alias("day_of_month"),
        F.month("event_date").alias("month"),
    )


# ---------------------------------------------------------------- A3
def daily_report(readings: DataFrame, date=None, tariff: Tariff = DEFAULT_TARIFF, by_device: bool = False) -> DataFrame:
    """A3: hourly consumption, peak power and cost for every day (or one ``date``)."""
    if date is not None:
        d = F.lit(str(date)[:10]).cast("date")
        readings = in_period(readings, d.cast("timestamp_ntz"), F.date_add(d, 1).cast("timestamp_ntz"))
    hourly = hourly_max(readings, by_device)
    part = [*_keys(by_device), "period_start"]
    hourly = meter_delta_keep_first(hourly, "max_energy", ["hour"], part)
    energy = js_round(F.col("consumption"), 2)
    low = is_low_tariff_parts(F.dayofweek("period_start"), F.col("hour"))
    c = reading_cost(F.col("energy"), low, tariff=tariff)
    return (hourly.withColumn("energy", energy)
            .select(*part, "hour", "energy",
                    js_round(F.coalesce("max_power", F.lit(0.0)), 2).alias("peak_power"),
                    c["cost"].alias("cost"), c["tariff_type"].alias("tariff_type")))


# ---------------------------------------------------------------- A4 / A5 / A6
def _priced_days(readings: DataFrame, tariff: Tariff, by_device: bool) -> DataFrame:
    """Days with data: rounded energy and peak, cost of the day's energy at 12:00."""
    d = daily_max(readings, by_device)
    energy = js_round(F.coalesce("max_energy", F.lit(0.0)), 2)
    noon_low = is_low_tariff_parts(F.col("day_of_week"), F.lit(12))
    return (d.withColumn("energy", energy)
             .withColumn("peak_power", js_round(F.coalesce("max_power", F.lit(0.0)), 2))
             .withColumn("cost", reading_cost(F.col("energy"), noon_low, tariff=tariff)["cost"]))


def _week_start(year: int, week: int):
    import datetime as _dt
    return _dt.date.fromisocalendar(int(year), int(week), 1)


def _restrict(readings: DataFrame, start, end_exclusive) -> DataFrame:
    """Rows of one requested period (F2, so the date bounds reach the scan)."""
    return in_period(readings, F.lit(start).cast("timestamp_ntz"), F.lit(end_exclusive).cast("timestamp_ntz"))


def weekly_report(readings: DataFrame, tariff: Tariff = DEFAULT_TARIFF, by_device: bool = False,
                  year: int | None = None, week: int | None = None) -> DataFrame:
    """A4: seven dense rows Mon..Sun per ISO week; missing days NULL.

    Without ``year``/``week``: every week with data.  With them: that week
    only, always seven rows (NULL when it has no data at all).
    """
    import datetime as _dt
    if year is not None and week is not None:
        ws = _week_start(year, week)
        readings = _restrict(readings, ws, ws + _dt.timedelta(days=7))
    days = _priced_days(readings, tariff, by_device).withColumn("period_start", F.trunc("date", "week"))
    keys = [*_keys(by_device), "period_start"]
    if year is not None and week is not None and not by_device:
        weeks = days.sparkSession.range(1).select(F.lit(ws).cast("date").alias("period_start"))
    else:
        weeks = days.select(*keys).distinct()
    # Calendar: one row per (week, weekday), built from the weeks only.
    cal_rows = (weeks.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(7))))
                .withColumn("date", F.date_add("period_start", F.col("day") - 1)))
    names = F.array(*[F.lit(n) for n in cal.DAY_NAMES_MON_FIRST])
    return (cal_rows.join(days.select(*keys, "date", "energy", "peak_power", "cost"), [*keys, "date"], "left")
            .select(*keys, "day", F.element_at(names, F.col("day")).alias("day_name"), "date",
                    "peak_power", "energy", "cost"))


def monthly_report(readings: DataFrame, tariff: Tariff = DEFAULT_TARIFF, by_device: bool = False,
                   year: int | None = None, month: int | None = None) -> DataFrame:
    """A5: one row per day with data, grouped under its month (or only ``year``-``month``)."""
    import datetime as _dt
    if year is not None and month is not None:
        ms = _dt.date(int(year), int(month), 1)
        nxt = _dt.date(ms.year + (ms.month == 12), ms.month % 12 + 1, 1)
        readings = _restrict(readings, ms, nxt)
    days = _priced_days(readings, tariff, by_device)
    return days.select(*_keys(by_device), F.trunc("date", "month").alias("period_start"),
                       F.col("day_of_month").alias("day"), "date", "peak_power", "energy", "cost")


def yearly_report(readings: DataFrame, tariff: Tariff = DEFAULT_TARIFF, by_device: bool = False,
                  year: int | None = None) -> DataFrame:
    """Months of every year (or of ``year``): sum of unrounded daily energy, sum of daily costs, max peak."""
    import datetime as _dt
    if year is not None:
        readings = _restrict(readings, _dt.date(int(year), 1, 1), _dt.date(int(year) + 1, 1, 1))
    d = daily_max(readings, by_device)
    raw = F.coalesce("max_energy", F.lit(0.0))
    noon_low = is_low_tariff_parts(F.col("day_of_week"), F.lit(12))
    d = d.withColumn("raw_energy", raw).withColumn("day_cost", reading_cost(raw, noon_low, tariff=tariff)["cost"])
    keys = [*_keys(by_device), F.trunc("date", "year").alias("period_start"), "month"]
    m = d.groupBy(*keys).agg(
        exact_sum("raw_energy").alias("energy_sum"),
        exact_sum("day_cost").alias("cost_sum"),
        F.max(F.coalesce("max_power", F.lit(0.0))).alias("peak_max"),
    )
    names = F.array(*[F.lit(n) for n in cal.MONTH_NAMES])
    return m.select(*_keys(by_device), "period_start", "month",
                    F.element_at(names, F.col("month")).alias("month_name"),
                    js_round(F.greatest(F.lit(0.0), "peak_max"), 2).alias("peak_power"),
                    js_round(F.col("energy_sum"), 2).alias("energy"),
                    js_round(F.col("cost_sum"), 2).alias("cost"))


# ---------------------------------------------------------------- A7 / A8
def report_summary(report: DataFrame, tariff: Tariff = DEFAULT_TARIFF, keys=("period_start",)) -> DataFrame:
    """Totals per period (NULL counts as 0), rounded; currency.

    With no ``keys`` (one requested period) an empty report gives its one row:
    energy 0, peak 0, no cost.
    """
    zero = F.lit(0.0)
    return (report.groupBy(*keys).agg(
        F.coalesce(js_round(exact_sum(F.coalesce("energy", zero)), 2), zero).alias("total_energy"),
        F.coalesce(js_round(F.max(F.coalesce("peak_power", zero)), 2), zero).alias("peak_power"),
        js_round(exact_sum(F.coalesce("cost", zero)), 2).alias("total_cost"),
    ).withColumn("currency", F.lit(tariff.currency)))


def _pct_change(cur: F.Column, prev: F.Column) -> F.Column:
    return (F.when(prev == 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise(F.floor((cur - prev) / prev * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)))


def period_comparison(summary: DataFrame, period: str, keys=()) -> DataFrame:
    """Change of energy and peak against the previous period, in % with 1 decimal.

    A previous period without rows gives no comparison (NULLs), except for
    weekly reports, which always have seven (possibly empty) rows.
    """
    cur = summary.withColumn("prev_period_start", cal.previous_period_start(F.col("period_start"), period))
    prev = summary.select(*keys, F.col("period_start").alias("prev_period_start"),
                          F.col("total_energy").alias("prev_total_energy"),
                          F.col("peak_power").alias("prev_peak_power"))
    j = cur.join(prev, [*keys, "prev_period_start"], "left")
    pe, pp = F.col("prev_total_energy"), F.col("prev_peak_power")
    if period == "weekly":
        pe, pp = F.coalesce(pe, F.lit(0.0)), F.coalesce(pp, F.lit(0.0))
    return j.select(*keys, "period_start", "prev_period_start",
                    pe.alias("prev_total_energy"), pp.alias("prev_peak_power"),
                    _pct_change(F.col("total_energy"), pe).alias("energy_change"),
                    _pct_change(F.col("peak_power"), pp).alias("peak_power_change"),
                    F.when(pe.isNotNull(), F.lit(cal.COMPARISON_LABELS[period])).alias("label"))


# ---------------------------------------------------------------- A9 / A10
def device_breakdown(readings: DataFrame, period: str = "monthly") -> DataFrame:
    """Per period and device: sum of daily maxima, share %, max peak; largest consumer first.

    Periods with at most one device give no rows.  Period totals come from a
    separate aggregate joined back (tiny: one row per period), so no window
    ever gathers a whole period into one task.
    """
    per_day = (readings.filter(F.col("has_energy"))
               .groupBy("device_id", "event_date")
               .agg(F.max("today_kwh").alias("daily_energy"), F.max("power_w").alias("peak")))
    per_day = per_day.withColumn("period_start", cal.period_start(F.col("event_date"), period))
    dev = (per_day.groupBy("period_start", "device_id")
           .agg(exact_sum("daily_energy").alias("dev_energy"), F.max("peak").alias("dev_peak")))
    tot = dev.groupBy("period_start").agg(
        exact_sum("dev_energy").alias("period_energy"), F.count(F.lit(1)).alias("n_devices"))
    j = dev.join(tot, "period_start").filter(F.col("n_devices") > 1)
    share = F.when(F.col("period_energy") > 0,
                   F.floor(F.col("dev_energy") / F.col("period_energy") * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)
                   ).otherwise(F.lit(0.0))
    return j.select("period_start",
                    F.coalesce("device_id", F.lit("unknown")).alias("device_id"),
                    js_round(F.coalesce("dev_energy", F.lit(0.0)), 2).alias("total_energy"),
                    share.cast("double").alias("percentage"),
                    js_round(F.coalesce("dev_peak", F.lit(0.0)), 2).alias("peak_power"),
                    F.col("dev_energy").alias("_order")) \
        .orderBy("period_start", F.col("_order").desc(), "device_id").drop("_order")


def device_list(readings: DataFrame) -> DataFrame:
    """A10: per device: type (earliest document's, default tasmota), last seen, simulated flag."""
    first = F.struct("processing_ts", "reading_id")
    return (readings.groupBy("device_id").agg(
        F.coalesce(F.min_by("device_type", first), F.lit("tasmota")).alias("device_type"),
        F.max("processing_ts").alias("last_seen"),
        F.coalesce(F.min_by("is_simulated", first), F.lit(False)).alias("is_simulated"),
    ).orderBy("device_id"))


# ---------------------------------------------------------------- W8
def dense_series(report: DataFrame, period: str) -> DataFrame:
    """Every hour (daily) or day (weekly/monthly) of each reported period with its peak or NULL."""
    starts = report.select("period_start").distinct()
    if period == "daily":
        slots = starts.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        slots = slots.withColumn("slot_ts", F.col("period_start").cast("timestamp_ntz")
                                 + F.make_dt_interval(hours=F.col("hour")))
        vals = report.select("period_start", "hour", "peak_power")
        out = slots.join(vals, ["period_start", "hour"], "left")
    else:
        end = cal.period_end(F.col("period_start"), period)
        slots = starts.withColumn("date", F.explode(F.sequence(F.col("period_start"), end)))
        slots = slots.withColumn("slot_ts", F.col("date").cast("timestamp_ntz"))
        vals = report.select("period_start", "date", "peak_power")
        out = slots.join(vals, ["period_start", "date"], "left")
    return out.select("period_start", "slot_ts", "peak_power")


# ---------------------------------------------------------------- one-request form
def report_rows(readings: DataFrame) -> DataFrame:
    """Readings reduced to what reports look at: per device, date and hour the largest counter and power, as readings.

    Every report takes maxima of days or hours, so it says the same of these rows.
    """
    g = readings.filter(F.col("has_energy")).groupBy("device_id", "event_date", F.date_trunc("hour", "event_ts").cast("timestamp_ntz").alias("event_ts"))
    return g.agg(F.max("today_kwh").alias("today_kwh"), F.max("power_w").alias("power_w")).withColumn("has_energy", F.lit(True))


def generate_report(readings: DataFrame, report_type: str = "daily", date=None, year: int | None = None,
                    week: int | None = None, month: int | None = None, tariff: Tariff = DEFAULT_TARIFF) -> dict:
    """Report of one requested period with its summary, comparison and device breakdown.

    Returns DataFrames ``data``, ``summary``, ``comparison`` (empty when the
    previous period has no rows, except weekly) and ``device_breakdown``
    (empty with at most one device), like one report request of the reference.
    Readings are scanned once: the hourly maxima of both periods (:func:`report_rows`,
    at most 24 rows per device and day) are stored, and all four read them.
    """
    import datetime as _dt
    kind = report_type.lower()
    if kind == "daily":
        d = _dt.date.fromisoformat(str(date)[:10])
        start, prev, end = d, d - _dt.timedelta(days=1), d + _dt.timedelta(days=1)
    elif kind == "weekly":
        start = _week_start(year, week)
        prev, end = start - _dt.timedelta(days=7), start + _dt.timedelta(days=7)
    elif kind == "monthly":
        start = _dt.date(int(year), int(month), 1)
        prev = _dt.date(start.year - (start.month == 1), (start.month - 2) % 12 + 1, 1)
        end = _dt.date(start.year + (start.month == 12), start.month % 12 + 1, 1)
    elif kind == "yearly":
        start, prev, end = (_dt.date(int(year) + i, 1, 1) for i in (0, -1, 1))
    else:
        raise ValueError(f"Invalid report type: {report_type}")
    readings = saved(report_rows(_restrict(readings, prev, end)), "report")
    if kind == "daily":
        cur_rows, prev_rows = (daily_report(readings, date=x, tariff=tariff) for x in (start, prev))
    elif kind == "weekly":
        cur_rows, prev_rows = (weekly_report(readings, tariff, year=x.isocalendar()[0], week=x.isocalendar()[1]) for x in (start, prev))
    elif kind == "monthly":
        cur_rows, prev_rows = (monthly_report(readings, tariff, year=x.year, month=x.month) for x in (start, prev))
    else:
        cur_rows, prev_rows = (yearly_report(readings, tariff, year=x.year) for x in (start, prev))
    summary = report_summary(cur_rows, tariff)
    both = summary.unionByName(report_summary(prev_rows, tariff))
    comparison = period_comparison(both, kind).filter(F.col("period_start") == F.lit(start))
    if kind != "weekly":
        comparison = comparison.filter(F.col("label").isNotNull())
    breakdown = device_breakdown(_restrict(readings, start, end), "yearly" if kind == "yearly" else kind)
    return {"data": cur_rows, "summary": summary, "comparison": comparison, "device_breakdown": breakdown}
