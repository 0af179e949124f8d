"""Registered dashboard queries (A11-A15, W2) and their oracle SQL."""

from __future__ import annotations

from ..operators import dashboard as D
from ..sources import fixtures as fx
from . import oracle as O
from .registry import register

W = O.with_fixtures
AS_OF_DASH = "2024-01-30 18:00:00"
T = O.ts(AS_OF_DASH)
METRICS = [m for m, _ in D.LATEST_METRICS]
PRESENT = {"power": "power_w", "voltage": "voltage_v", "energy_today": "today_kwh", "current": "current_a", "power_factor": "power_factor",
           "apparent_power": "apparent_power_va", "reactive_power": "reactive_power_var", "energy_total": "total_kwh"}


def _rf(keys: str = "") -> str:
    return f"""rf AS (SELECT * FROM readings WHERE has_energy
  AND processing_ts >= {T} - INTERVAL 7 DAY AND processing_ts <= {T})"""


def _latest_sql(by_device: bool) -> str:
    k = "device_id, " if by_device else ""
    part = "PARTITION BY device_id " if by_device else ""
    cols = ", ".join(
        (f"CASE WHEN has_energy THEN coalesce({O.num_text(PRESENT[m])}, '0') ELSE '0' END AS {m}"
         if m in PRESENT else f"'0' AS {m}") for m in METRICS)
    return f"""lt AS (
  SELECT {k}{cols}, processing_ts FROM rf
  QUALIFY row_number() OVER ({part}ORDER BY processing_ts DESC, reading_id DESC) = 1)"""


register("dashboard_latest", W("SELECT * FROM lt", _rf() + "," + _latest_sql(False)), "dashboard")(
    lambda spark, sf: D.dashboard_latest(fx.readings(spark, sf), AS_OF_DASH))
register("dashboard_latest_by_device", W("SELECT * FROM lt", _rf() + "," + _latest_sql(True)), "dashboard")(
    lambda spark, sf: D.dashboard_latest(fx.readings(spark, sf), AS_OF_DASH, by_device=True))


def _hourly_sql(by_device: bool) -> str:
    k = "device_id, " if by_device else ""
    part = "PARTITION BY device_id " if by_device else ""
    return f"""hb AS (
  SELECT {k}date_trunc('hour', event_ts) AS timestamp, {O.exact_avg('power_w')} AS avg_power,
         max(power_w) AS max_power, max(today_kwh) AS energy
  FROM rf WHERE processing_ts >= {T} - INTERVAL 25 HOUR GROUP BY ALL),
hd AS (
  SELECT {k}timestamp, {O.half_even('avg_power', 1)} AS power, {O.half_even('max_power', 1)} AS peak_power,
         row_number() OVER ({part}ORDER BY timestamp) AS n, coalesce(energy, 0.0e0) AS cur,
         lag(coalesce(energy, 0.0e0)) OVER ({part}ORDER BY timestamp) AS prev FROM hb),
hourly AS (
  SELECT {k}timestamp, power, peak_power,
         {O.js_round('CASE WHEN cur < prev THEN cur ELSE greatest(0.0e0, cur - prev) END', 2)} AS consumption
  FROM hd WHERE n > 1)"""


register("dashboard_hourly", W("SELECT * FROM hourly", _rf() + "," + _hourly_sql(False)), "dashboard")(
    lambda spark, sf: D.dashboard_hourly(fx.readings(spark, sf), AS_OF_DASH))
register("dashboard_hourly_by_device", W("SELECT * FROM hourly", _rf() + "," + _hourly_sql(True)), "dashboard")(
    lambda spark, sf: D.dashboard_hourly(fx.readings(spark, sf), AS_OF_DASH, by_device=True))
register("meter_delta_baseline", W("SELECT device_id, timestamp, consumption FROM hourly",
                                   _rf() + "," + _hourly_sql(True)), "dashboard")(
    lambda spark, sf: D.dashboard_hourly(fx.readings(spark, sf), AS_OF_DASH, by_device=True)
    .select("device_id", "timestamp", "consumption"))


@register("dashboard_daily", W(f"""
SELECT CAST(processing_ts AS DATE) AS date, {O.exact_avg('power_w')} AS avg_power, max(power_w) AS max_power,
       min(power_w) AS min_power, coalesce(max(today_kwh), 0.0e0) AS energy_consumed, count(*) AS reading_count
FROM rf GROUP BY 1""", _rf()), "dashboard")
def q_dashboard_daily(spark, sf):
    return D.dashboard_daily(fx.readings(spark, sf), AS_OF_DASH)


def _today_sql(by_device: bool) -> str:
    k = "device_id, " if by_device else ""
    part = "PARTITION BY device_id " if by_device else ""
    return W(f"""
SELECT * FROM (
  SELECT {k}row_number() OVER ({part}ORDER BY processing_ts, reading_id) AS seq,
         coalesce(time_utc, payload_ts, processing_ts) AS timestamp, power_w AS power, voltage_v AS voltage, today_kwh AS energy
  FROM rf WHERE processing_ts >= date_trunc('day', {T})) t""", _rf())


register("dashboard_today", _today_sql(False), "dashboard")(
    lambda spark, sf: D.dashboard_today(fx.readings(spark, sf), AS_OF_DASH))
register("dashboard_today_by_device", _today_sql(True), "dashboard")(
    lambda spark, sf: D.dashboard_today(fx.readings(spark, sf), AS_OF_DASH, by_device=True))


def _cost_sql(by_device: bool) -> str:
    k = "device_id, " if by_device else ""
    hour = f"CAST(hour({T}) AS INTEGER)"
    c = O.reading_cost("consumption", O.is_low(O.dow_sun1("timestamp"), "CAST(hour(timestamp) AS INTEGER)"))
    est = O.today_estimate("coalesce(energy_today, 0.0e0)", hour)
    join = "LEFT JOIN tot USING (device_id)" if by_device else "LEFT JOIN tot ON true"
    return W(f"""
SELECT {k}CASE WHEN coalesce(n_hours, 0) > 0 THEN {O.js_round('total', 2)} ELSE {est['value']} END AS value,
       'MKD' AS currency,
       CASE WHEN coalesce(n_hours, 0) > 0 THEN (CASE WHEN {hour} < 8 THEN 'low' WHEN {hour} < 16 THEN 'medium' ELSE 'high' END)
            ELSE {est['confidence']} END AS confidence,
       CASE WHEN coalesce(n_hours, 0) > 0 THEN (CASE WHEN {hour} > 0 THEN {O.js_round(f'total / {hour} * 24.0e0', 2)} ELSE total END)
            ELSE {est['projected_daily']} END AS projected_daily
FROM (SELECT {k}CAST(energy_today AS DOUBLE) AS energy_today FROM lt) b {join}""",
             _rf() + "," + _latest_sql(by_device) + "," + _hourly_sql(by_device) + f""",
tot AS (SELECT {k}{O.exact_sum(c['cost'])} AS total, count(*) AS n_hours FROM hourly GROUP BY ALL)""")


def _cost(spark, sf, by_device):
    r = fx.readings(spark, sf)
    return D.dashboard_cost(D.dashboard_hourly(r, AS_OF_DASH, by_device), D.dashboard_latest(r, AS_OF_DASH, by_device),
                            AS_OF_DASH, by_device=by_device)


register("dashboard_cost", _cost_sql(False), "dashboard")(lambda spark, sf: _cost(spark, sf, False))
register("dashboard_cost_by_device", _cost_sql(True), "dashboard")(lambda spark, sf: _cost(spark, sf, True))


# ------------------------------------------------------------------ all answers from one pass of cells
for _by, _name in ((False, "dashboard_request"), (True, "dashboard_request_by_device")):
    register(f"{_name}_hourly", W("SELECT * FROM hourly", _rf() + "," + _hourly_sql(_by)), "dashboard")(
        lambda spark, sf, by=_by: D.generate_dashboard(fx.readings(spark, sf), AS_OF_DASH, by_device=by)["hourly"])
    register(f"{_name}_cost", _cost_sql(_by), "dashboard")(
        lambda spark, sf, by=_by: D.generate_dashboard(fx.readings(spark, sf), AS_OF_DASH, by_device=by)["cost"])
