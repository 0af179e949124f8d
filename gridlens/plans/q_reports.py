"""Registered report queries (S1, F1-F5, A1-A10, W1, W8) and their oracle SQL."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import periods as P
from ..operators import reports as R
from ..sources import fixtures as fx
from ..sources.ingest import read_readings
from ..sources.sinks import write_table
from ..streaming.streams import work_dir
from . import oracle as O
from .registry import register

W = O.with_fixtures


# ------------------------------------------------------------------ S1 / F1-F5
@register("read_readings", W("SELECT * FROM readings"), "reports")
def q_read_readings(spark, sf):
    """Readings written in the stored layout and scanned by the reader."""
    path = posixpath.join(work_dir(spark, "readings"), "table")
    write_table(fx.readings(spark, sf), path)
    return read_readings(spark, path)


@register("event_time", W("""
SELECT reading_id, coalesce(payload_ts, processing_ts) AS event_ts,
       CAST(coalesce(payload_ts, processing_ts) AS DATE) AS event_date FROM readings"""), "reports")
def q_event_time(spark, sf):
    return P.event_time(fx.readings(spark, sf).drop("event_ts", "event_date")).select("reading_id", "event_ts", "event_date")


@register("in_period", W("""
SELECT reading_id, device_id, event_ts, today_kwh FROM readings
WHERE has_energy AND event_ts >= TIMESTAMP '2024-01-08 00:00:00' AND event_ts < TIMESTAMP '2024-01-15 00:00:00'"""), "reports")
def q_in_period(spark, sf):
    return P.in_period(fx.readings(spark, sf), "2024-01-08", "2024-01-15").select("reading_id", "device_id", "event_ts", "today_kwh")


@register("with_period", W("""
SELECT reading_id, CAST(date_trunc('week', event_date) AS DATE) AS period_start,
       CAST(date_trunc('week', event_date) AS DATE) + 6 AS period_end,
       printf('%d-W%02d', isoyear(event_date), weekofyear(event_date)) AS period_label
FROM meter_days"""), "reports")
def q_with_period(spark, sf):
    return P.with_period(fx.meter_days(spark, sf), "weekly").select("reading_id", "period_start", "period_end", "period_label")


@register("with_previous_period", W("""
SELECT DISTINCT CAST(date_trunc('week', event_date) AS DATE) AS period_start,
       CAST(date_trunc('week', event_date) AS DATE) - 7 AS prev_period_start,
       CAST(weekofyear(CAST(date_trunc('week', event_date) AS DATE) - 7) AS INTEGER) AS prev_week,
       CAST(weekofyear(make_date(CAST(isoyear(event_date) AS INTEGER) - 1, 12, 28)) AS INTEGER) AS weeks_in_prev_year
FROM meter_days"""), "reports")
def q_with_previous_period(spark, sf):
    df = P.with_previous_period(P.with_period(fx.meter_days(spark, sf), "weekly"), "weekly")
    return df.select("period_start", "prev_period_start",
                     F.weekofyear("prev_period_start").alias("prev_week"),
                     cal.iso_weeks_in_year(cal.iso_year(F.col("event_date")) - 1).alias("weeks_in_prev_year")).distinct()


@register("filter_devices", W("""
SELECT reading_id, device_id, device_type FROM readings WHERE device_type = 'shelly_pro_3em'"""), "reports")
def q_filter_devices(spark, sf):
    return P.filter_devices(fx.readings(spark, sf), device_type="shelly_pro_3em").select("reading_id", "device_id", "device_type")


@register("filter_devices_default", W("""
SELECT reading_id, device_id, device_type FROM readings WHERE has_energy"""), "reports")
def q_filter_devices_default(spark, sf):
    return P.filter_devices(fx.readings(spark, sf)).select("reading_id", "device_id", "device_type")


# ------------------------------------------------------------------ A1 / A2 / W1 / A3
_HOURLY = """h AS (
  SELECT {keys} event_date AS period_start, CAST(hour(event_ts) AS INTEGER) AS hour,
         max(today_kwh) AS max_energy, max(power_w) AS max_power
  FROM {src} WHERE has_energy GROUP BY ALL)"""

register("hourly_max", W("SELECT * FROM h", _HOURLY.format(keys="", src="readings")), "reports")(
    lambda spark, sf: R.hourly_max(fx.readings(spark, sf)))

_DELTA = "CASE WHEN prev IS NULL THEN cur WHEN cur < prev THEN cur ELSE greatest(0.0e0, cur - prev) END"


@register("meter_delta_keep_first", W("""
SELECT device_id, period_start, hour, max_energy, {delta} AS consumption FROM (
  SELECT *, coalesce(max_energy, 0.0e0) AS cur,
         lag(coalesce(max_energy, 0.0e0)) OVER (PARTITION BY device_id, period_start ORDER BY hour) AS prev
  FROM h) t""".format(delta=_DELTA), _HOURLY.format(keys="device_id,", src="readings")), "reports")
def q_meter_delta_keep_first(spark, sf):
    h = R.hourly_max(fx.readings(spark, sf), by_device=True)
    return R.meter_delta_keep_first(h, "max_energy", ["hour"], ["device_id", "period_start"]) \
        .select("device_id", "period_start", "hour", "max_energy", "consumption")


def _daily_report_sql(by_device: bool) -> str:
    keys = "device_id," if by_device else ""
    part = "device_id, period_start" if by_device else "period_start"
    c = O.reading_cost("energy", "low")
    return W(f"""
SELECT {keys} period_start, hour, energy, {O.js_round('coalesce(max_power, 0.0e0)', 2)} AS peak_power,
       {c['cost']} AS cost, {c['tariff_type']} AS tariff_type
FROM (
  SELECT *, {O.js_round(_DELTA, 2)} AS energy, {O.is_low(O.dow_sun1('period_start'), 'hour')} AS low
  FROM (SELECT *, coalesce(max_energy, 0.0e0) AS cur,
               lag(coalesce(max_energy, 0.0e0)) OVER (PARTITION BY {part} ORDER BY hour) AS prev FROM h) d) e""",
             _HOURLY.format(keys=keys, src="readings"))


register("daily_report", _daily_report_sql(False), "reports")(
    lambda spark, sf: R.daily_report(fx.readings(spark, sf)))
register("daily_report_by_device", _daily_report_sql(True), "reports")(
    lambda spark, sf: R.daily_report(fx.readings(spark, sf), by_device=True))

_DAILY = """dm AS (
  SELECT event_date AS date, max(today_kwh) AS max_energy, max(power_w) AS max_power,
         CAST(dayofweek(event_date) AS INTEGER) + 1 AS day_of_week,
         CAST(dayofmonth(event_date) AS INTEGER) AS day_of_month, CAST(month(event_date) AS INTEGER) AS month
  FROM {src} WHERE has_energy GROUP BY event_date)"""

register("daily_max", W("SELECT * FROM dm", _DAILY.format(src="readings")), "reports")(
    lambda spark, sf: R.daily_max(fx.readings(spark, sf)))

_NOON_LOW = O.is_low("day_of_week", "12")
_PRICED = _DAILY.format(src="meter_days") + f""",
pd AS (
  SELECT *, {O.reading_cost('energy', _NOON_LOW)['cost']} AS cost FROM (
    SELECT *, {O.js_round('coalesce(max_energy, 0.0e0)', 2)} AS energy,
           {O.js_round('coalesce(max_power, 0.0e0)', 2)} AS peak_power FROM dm) x)"""

_WEEKLY = _PRICED + """,
wk AS (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) AS period_start FROM pd),
wcal AS (SELECT period_start, CAST(d AS INTEGER) AS day, period_start + CAST(d AS INTEGER) - 1 AS date
         FROM wk, range(1, 8) t(d)),
weekly AS (
  SELECT c.period_start, c.day,
         (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[c.day] AS day_name, c.date,
         p.peak_power, p.energy, p.cost
  FROM wcal c LEFT JOIN pd p ON p.date = c.date)"""

register("weekly_report", W("SELECT * FROM weekly", _WEEKLY), "reports")(
    lambda spark, sf: R.weekly_report(fx.meter_days(spark, sf)))

_MONTHLY = _PRICED + """,
monthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, day_of_month AS day, date,
                   peak_power, energy, cost FROM pd)"""

register("monthly_report", W("SELECT * FROM monthly", _MONTHLY), "reports")(
    lambda spark, sf: R.monthly_report(fx.meter_days(spark, sf)))

_YEARLY = _DAILY.format(src="meter_days") + f""",
yd AS (SELECT *, coalesce(max_energy, 0.0e0) AS raw_energy,
              {O.reading_cost('coalesce(max_energy, 0.0e0)', _NOON_LOW)['cost']} AS day_cost FROM dm),
yearly AS (
  SELECT CAST(date_trunc('year', date) AS DATE) AS period_start, month,
         (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] AS month_name,
         {O.js_round('greatest(0.0e0, max(coalesce(max_power, 0.0e0)))', 2)} AS peak_power,
         {O.js_round(O.exact_sum('raw_energy'), 2)} AS energy,
         {O.js_round(O.exact_sum('day_cost'), 2)} AS cost
  FROM yd GROUP BY 1, 2)"""

register("yearly_report", W("SELECT * FROM yearly", _YEARLY), "reports")(
    lambda spark, sf: R.yearly_report(fx.meter_days(spark, sf)))


# ------------------------------------------------------------------ A7 / A8
def _summary_sql(report: str) -> str:
    return f"""summary AS (
  SELECT period_start,
         {O.js_round(O.exact_sum('coalesce(energy, 0.0e0)'), 2)} AS total_energy,
         {O.js_round('max(coalesce(peak_power, 0.0e0))', 2)} AS peak_power,
         {O.js_round(O.exact_sum('coalesce(cost, 0.0e0)'), 2)} AS total_cost,
         'MKD' AS currency
  FROM {report} GROUP BY period_start)"""


register("report_summary", W("SELECT * FROM summary", _WEEKLY + "," + _summary_sql("weekly")), "reports")(
    lambda spark, sf: R.report_summary(R.weekly_report(fx.meter_days(spark, sf))))


def _pct(cur: str, prev: str) -> str:
    return (f"(CASE WHEN {prev} = 0 THEN (CASE WHEN {cur} > 0 THEN 100.0e0 ELSE 0.0e0 END)"
            f" ELSE floor(({cur} - {prev}) / {prev} * 1000.0e0 + 0.5e0) / 10.0e0 END)")


def _comparison_sql(prev_expr: str, label: str, weekly: bool) -> str:
    pe = "coalesce(p.total_energy, 0.0e0)" if weekly else "p.total_energy"
    pp = "coalesce(p.peak_power, 0.0e0)" if weekly else "p.peak_power"
    return f"""
SELECT s.period_start, {prev_expr} AS prev_period_start, {pe} AS prev_total_energy, {pp} AS prev_peak_power,
       {_pct('s.total_energy', pe)} AS energy_change, {_pct('s.peak_power', pp)} AS peak_power_change,
       CASE WHEN {pe} IS NOT NULL THEN '{label}' END AS label
FROM summary s LEFT JOIN summary p ON p.period_start = {prev_expr}"""


register("period_comparison", W(_comparison_sql("CAST(s.period_start - INTERVAL 1 MONTH AS DATE)", "vs last month", False),
                                _MONTHLY + "," + _summary_sql("monthly")), "reports")(
    lambda spark, sf: R.period_comparison(R.report_summary(R.monthly_report(fx.meter_days(spark, sf))), "monthly"))

register("period_comparison_weekly", W(_comparison_sql("s.period_start - 7", "vs last week", True),
                                       _WEEKLY + "," + _summary_sql("weekly")), "reports")(
    lambda spark, sf: R.period_comparison(R.report_summary(R.weekly_report(fx.meter_days(spark, sf))), "weekly"))


# ------------------------------------------------------------------ A9 / A10 / W8
@register("device_breakdown", W(f"""
SELECT d.period_start, coalesce(d.device_id, 'unknown') AS device_id,
       {O.js_round('coalesce(dev_energy, 0.0e0)', 2)} AS total_energy,
       CASE WHEN period_energy > 0 THEN floor(dev_energy / period_energy * 1000.0e0 + 0.5e0) / 10.0e0 ELSE 0.0e0 END AS percentage,
       {O.js_round('coalesce(dev_peak, 0.0e0)', 2)} AS peak_power
FROM dev d JOIN tot t ON d.period_start = t.period_start
WHERE n_devices > 1""", f"""
pday AS (SELECT device_id, event_date, max(today_kwh) AS daily_energy, max(power_w) AS peak
         FROM readings WHERE has_energy GROUP BY device_id, event_date),
dev AS (SELECT CAST(date_trunc('week', event_date) AS DATE) AS period_start, device_id,
               {O.exact_sum('daily_energy')} AS dev_energy, max(peak) AS dev_peak FROM pday GROUP BY 1, 2),
tot AS (SELECT period_start, {O.exact_sum('dev_energy')} AS period_energy, count(*) AS n_devices FROM dev GROUP BY 1)"""),
    "reports")
def q_device_breakdown(spark, sf):
    return R.device_breakdown(fx.readings(spark, sf), "weekly")


@register("device_list", W("""
SELECT device_id, coalesce(min_by(device_type, (processing_ts, reading_id)), 'tasmota') AS device_type,
       max(processing_ts) AS last_seen, coalesce(min_by(is_simulated, (processing_ts, reading_id)), false) AS is_simulated
FROM readings GROUP BY device_id"""), "reports")
def q_device_list(spark, sf):
    return R.device_list(fx.readings(spark, sf))


_DAILY_REPORT_CTE = _HOURLY.format(keys="", src="readings") + f""",
dr AS (
  SELECT period_start, hour, {O.js_round('coalesce(max_power, 0.0e0)', 2)} AS peak_power FROM h)"""


@register("dense_series", W("""
SELECT s.period_start, CAST(s.period_start AS TIMESTAMP) + to_hours(CAST(g.hr AS INTEGER)) AS slot_ts, dr.peak_power
FROM (SELECT DISTINCT period_start FROM dr) s CROSS JOIN range(0, 24) g(hr)
LEFT JOIN dr ON dr.period_start = s.period_start AND dr.hour = g.hr""", _DAILY_REPORT_CTE), "reports")
def q_dense_series(spark, sf):
    return R.dense_series(R.daily_report(fx.readings(spark, sf)), "daily")


@register("dense_series_monthly", W("""
SELECT s.period_start, CAST(g.d AS TIMESTAMP) AS slot_ts, m.peak_power
FROM (SELECT DISTINCT period_start FROM monthly) s,
     LATERAL (SELECT unnest(generate_series(s.period_start, last_day(s.period_start), INTERVAL 1 DAY)) AS d) g
LEFT JOIN monthly m ON m.period_start = s.period_start AND m.date = CAST(g.d AS DATE)""", _MONTHLY), "reports")
def q_dense_series_monthly(spark, sf):
    return R.dense_series(R.monthly_report(fx.meter_days(spark, sf)), "monthly")


# ------------------------------------------------------------------ one requested period (reference request form)
def _priced_sql(src: str, lo: str, hi: str) -> str:
    dm = _DAILY.format(src=f"(SELECT * FROM {src} WHERE event_ts >= TIMESTAMP '{lo}' AND event_ts < TIMESTAMP '{hi}')")
    return dm + f""",
pd AS (
  SELECT *, {O.reading_cost('energy', _NOON_LOW)['cost']} AS cost FROM (
    SELECT *, {O.js_round('coalesce(max_energy, 0.0e0)', 2)} AS energy,
           {O.js_round('coalesce(max_power, 0.0e0)', 2)} AS peak_power FROM dm) x)"""


def _week_sql(week_start: str, week_end: str) -> str:
    return W(f"""
SELECT DATE '{week_start}' AS period_start, CAST(d AS INTEGER) AS day,
       (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[CAST(d AS INTEGER)] AS day_name,
       DATE '{week_start}' + CAST(d AS INTEGER) - 1 AS date, p.peak_power, p.energy, p.cost
FROM range(1, 8) t(d) LEFT JOIN pd p ON p.date = DATE '{week_start}' + CAST(d AS INTEGER) - 1""",
             _priced_sql("readings", f"{week_start} 00:00:00", f"{week_end} 00:00:00"))


register("weekly_report_for_week", _week_sql("2024-01-15", "2024-01-22"), "reports")(
    lambda spark, sf: R.weekly_report(fx.readings(spark, sf), year=2024, week=3))
register("weekly_report_empty_week", _week_sql("2024-03-04", "2024-03-11"), "reports")(
    lambda spark, sf: R.weekly_report(fx.readings(spark, sf), year=2024, week=10))
register("monthly_report_for_month", W("""
SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, day_of_month AS day, date, peak_power, energy, cost
FROM pd""", _priced_sql("meter_days", "1998-12-01 00:00:00", "1999-01-01 00:00:00")), "reports")(
    lambda spark, sf: R.monthly_report(fx.meter_days(spark, sf), year=1998, month=12))
register("yearly_report_for_year", W("SELECT * FROM yearly WHERE period_start = DATE '1998-01-01'", _YEARLY), "reports")(
    lambda spark, sf: R.yearly_report(fx.meter_days(spark, sf), year=1998))


# ------------------------------------------------------------------ one request's four answers, from one scan
_REQUEST = "1996-05-01"
_IN_REQUEST = f"period_start = DATE '{_REQUEST}'"


def _request(spark, sf, answer):
    return R.generate_report(fx.meter_days(spark, sf), "monthly", year=1996, month=5)[answer]


for _answer, _sql in {
    "data": W(f"SELECT * FROM monthly WHERE {_IN_REQUEST}", _MONTHLY),
    "summary": W(f"SELECT * FROM summary WHERE {_IN_REQUEST}", _MONTHLY + "," + _summary_sql("monthly")),
    "comparison": W(f"SELECT * FROM ({_comparison_sql('CAST(s.period_start - INTERVAL 1 MONTH AS DATE)', 'vs last month', False)}) c WHERE {_IN_REQUEST}",
                    _MONTHLY + "," + _summary_sql("monthly")),
    "device_breakdown": W(f"""
SELECT DATE '{_REQUEST}' AS period_start, coalesce(device_id, 'unknown') AS device_id, {O.js_round('coalesce(dev_energy, 0.0e0)', 2)} AS total_energy,
       CASE WHEN period_energy > 0 THEN floor(dev_energy / period_energy * 1000.0e0 + 0.5e0) / 10.0e0 ELSE 0.0e0 END AS percentage,
       {O.js_round('coalesce(dev_peak, 0.0e0)', 2)} AS peak_power
FROM dev, (SELECT {O.exact_sum('dev_energy')} AS period_energy, count(*) AS n FROM dev) t WHERE n > 1""", f"""
pday AS (SELECT device_id, event_date, max(today_kwh) AS daily_energy, max(power_w) AS peak FROM meter_days
         WHERE has_energy AND CAST(date_trunc('month', event_date) AS DATE) = DATE '{_REQUEST}' GROUP BY 1, 2),
dev AS (SELECT device_id, {O.exact_sum('daily_energy')} AS dev_energy, max(peak) AS dev_peak FROM pday GROUP BY 1)"""),
}.items():
    register(f"report_request_{_answer}", _sql, "reports")(lambda spark, sf, answer=_answer: _request(spark, sf, answer))
