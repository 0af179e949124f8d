"""SQL text of the fixtures and of the shared expressions, for the DuckDB oracle.

The oracle re-derives every answer from the raw Parquet tables with plain
SQL; these helpers only produce SQL text (the same formulas as the Spark
column expressions, written once more by hand for the other engine).
"""

from __future__ import annotations

import math

from ..functions.tariff import DEFAULT_TARIFF, ESTIMATE_HIGH_SHARE, ESTIMATE_LOW_SHARE, Tariff

FIXTURE_CTE = """
base AS (
  SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
fx AS (
  SELECT event_id AS reading_id, user_id,
         'dev_' || CAST(user_id AS VARCHAR) AS device_id,
         CASE WHEN user_id % 5 = 0 THEN 'shelly_pro_3em' ELSE 'tasmota' END AS device_type,
         user_id % 2 = 0 AS is_simulated,
         user_id % 5 <> 0 AS has_energy,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS payload_ts,
         ts + INTERVAL 2 SECOND AS processing_ts,
         ts + INTERVAL 5 SECOND AS insert_ts,
         CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 SECOND ELSE ts END AS event_ts,
         cents AS power_dw,
         CAST(SUM(cents) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS today_ch,
         220 + k % 20 AS voltage
  FROM base),
rbase AS (
  SELECT reading_id, device_id || '-' || CAST(reading_id AS VARCHAR) AS doc_id, device_id, device_type,
         is_simulated, has_energy, user_id, payload_ts, processing_ts, insert_ts, event_ts,
         CAST(event_ts AS DATE) AS event_date,
         CASE WHEN has_energy THEN CAST(power_dw AS DOUBLE) / 10 END AS power_w,
         CASE WHEN has_energy THEN CAST(today_ch AS DOUBLE) / 100 END AS today_kwh,
         CASE WHEN has_energy THEN CAST(voltage AS DOUBLE) END AS voltage_v,
         CASE WHEN has_energy THEN NULL ELSE CAST(power_dw AS DOUBLE) / 10 END AS meter_power_w,
         CASE WHEN has_energy THEN CAST(power_dw % 1000 AS DOUBLE) / 100 END AS current_a,
         CASE WHEN has_energy THEN CAST(50 + reading_id % 50 AS DOUBLE) / 100 END AS power_factor,
         CASE WHEN has_energy THEN CAST(power_dw + 50 AS DOUBLE) / 10 END AS apparent_power_va,
         CASE WHEN has_energy THEN CAST(power_dw % 700 AS DOUBLE) / 10 END AS reactive_power_var,
         CASE WHEN has_energy THEN CAST(today_ch + 100000 AS DOUBLE) / 100 END AS total_kwh,
         CASE WHEN has_energy THEN CAST(reading_id % 900 AS DOUBLE) / 100 END AS yesterday_kwh,
         CASE WHEN has_energy THEN CAST(reading_id % 60 AS DOUBLE) END AS period_wh,
         CASE WHEN has_energy THEN '2023-01-01T00:00:00' END AS total_start_time,
         CASE WHEN reading_id % 11 = 0 THEN processing_ts - INTERVAL 1 SECOND END AS time_utc,
         CASE WHEN is_simulated THEN '{"simulated":true}' END AS metadata,
         power_dw, today_ch
  FROM fx),
readings AS (
  SELECT reading_id, doc_id, device_id, device_type, is_simulated, has_energy, payload_ts, processing_ts,
         insert_ts, event_ts, event_date, power_w, today_kwh, voltage_v, meter_power_w, current_a, power_factor, apparent_power_va,
         reactive_power_var, total_kwh, yesterday_kwh, period_wh, total_start_time, time_utc, metadata
  FROM rbase),
meter_days AS (
  SELECT o_orderkey AS reading_id,
         'cust_' || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS doc_id,
         'cust_' || CAST(o_custkey AS VARCHAR) AS device_id, 'tasmota' AS device_type,
         false AS is_simulated, true AS has_energy,
         o_orderdate AS payload_ts, o_orderdate AS processing_ts, o_orderdate AS insert_ts,
         o_orderdate AS event_ts, CAST(o_orderdate AS DATE) AS event_date,
         CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS DOUBLE) / 10 AS power_w,
         CAST(CAST(floor(o_totalprice / 500) AS BIGINT) * 100 AS DOUBLE) / 100 AS today_kwh,
         CAST(NULL AS DOUBLE) AS voltage_v, CAST(NULL AS DOUBLE) AS meter_power_w,
         CAST(NULL AS DOUBLE) AS current_a, CAST(NULL AS DOUBLE) AS power_factor, CAST(NULL AS DOUBLE) AS apparent_power_va,
         CAST(NULL AS DOUBLE) AS reactive_power_var, CAST(NULL AS DOUBLE) AS total_kwh, CAST(NULL AS DOUBLE) AS yesterday_kwh,
         CAST(NULL AS DOUBLE) AS period_wh, CAST(NULL AS VARCHAR) AS total_start_time, CAST(NULL AS TIMESTAMP) AS time_utc, CAST(NULL AS VARCHAR) AS metadata
  FROM orders)"""


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    """``WITH <fixtures>[, extra] <body>``."""
    ctes = FIXTURE_CTE + ("," + extra_ctes if extra_ctes.strip() else "")
    return "WITH " + ctes + "\n" + body


def lit(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else f"{float(x)!r}"


def js_round(expr: str, digits: int = 0) -> str:
    s = lit(10 ** digits)
    return f"(floor(({expr}) * {s} + 0.5e0) / {s})"


def half_even(expr: str, digits: int = 1) -> str:
    return f"CAST(round_even(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def exact_sum(expr: str) -> str:
    return f"CAST(sum(CAST(({expr}) AS DECIMAL(38,10))) AS DOUBLE)"


def exact_avg(expr: str) -> str:
    return f"({exact_sum(expr)} / CAST(count({expr}) AS DOUBLE))"


def dow_sun1(date_expr: str) -> str:
    """Day of week with Sunday=1..Saturday=7 (Spark numbering)."""
    return f"(CAST(dayofweek({date_expr}) AS INTEGER) + 1)"


def is_low(dow1: str, hour: str) -> str:
    return (f"(({dow1}) = 1 OR (({dow1}) = 7 AND ({hour}) >= 22) OR (({dow1}) = 2 AND ({hour}) < 7)"
            f" OR (({hour}) >= 13 AND ({hour}) < 15) OR ({hour}) >= 22 OR ({hour}) < 7)")


def block_cost(kwh: str, cum: str = "0.0e0", tariff: Tariff = DEFAULT_TARIFF) -> str:
    terms = []
    upto = f"(({cum}) + ({kwh}))"
    for b in tariff.blocks:
        hi = upto if math.isinf(b.max_kwh) else f"least({upto}, {lit(b.max_kwh)})"
        terms.append(f"(greatest(0.0e0, {hi} - greatest({cum}, {lit(b.min_kwh)})) * {lit(b.rate)})")
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    return js_round(total, 2)


def effective_rate(cum: str, tariff: Tariff = DEFAULT_TARIFF) -> str:
    parts = ["CASE"]
    for b in tariff.blocks:
        if math.isinf(b.max_kwh):
            parts.append(f"WHEN true THEN {lit(b.rate)}")
        else:
            parts.append(f"WHEN ({cum}) <= {lit(b.max_kwh)} THEN {lit(b.rate)}")
    parts.append(f"ELSE {lit(tariff.blocks[-1].rate)} END")
    return " ".join(parts)


def reading_cost(kwh: str, low: str, tariff: Tariff = DEFAULT_TARIFF, cum: str = "0.0e0") -> dict:
    return {
        "cost": f"(CASE WHEN {low} THEN {js_round(f'({kwh}) * {lit(tariff.low_rate)}', 2)} ELSE {block_cost(kwh, cum, tariff)} END)",
        "tariff_type": f"(CASE WHEN {low} THEN 'low' ELSE 'high' END)",
        "rate": f"(CASE WHEN {low} THEN {lit(tariff.low_rate)} ELSE {effective_rate(f'({cum}) + ({kwh})', tariff)} END)",
        "currency": f"'{tariff.currency}'",
    }


def today_estimate(kwh: str, hour: str, tariff: Tariff = DEFAULT_TARIFF) -> dict:
    avg_high = (tariff.blocks[0].rate + tariff.blocks[1].rate) / 2
    est = (f"((({kwh}) * {lit(ESTIMATE_HIGH_SHARE)}) * {lit(avg_high)}"
           f" + (({kwh}) * {lit(ESTIMATE_LOW_SHARE)}) * {lit(tariff.low_rate)})")
    hours = f"greatest({hour}, 1)"
    return {
        "value": js_round(est, 2),
        "currency": f"'{tariff.currency}'",
        "confidence": f"(CASE WHEN {hours} < 8 THEN 'low' WHEN {hours} < 16 THEN 'medium' ELSE 'high' END)",
        "projected_daily": js_round(f"{est} / {hours} * 24.0e0", 2),
    }


def num_text(e: str) -> str:
    """JS ``String(x)`` for doubles in the common range (see functions.formatting)."""
    return (f"(CASE WHEN ({e}) IS NULL THEN NULL WHEN ({e}) = floor({e}) AND abs({e}) < 1e15 "
            f"THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END)")


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"
