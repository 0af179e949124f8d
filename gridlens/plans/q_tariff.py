"""Registered tariff queries (C1-C5, custom rates) and the CSV frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tariff as TF
from ..operators import reports as R
from ..sources import fixtures as fx
from ..sources.sinks import report_csv_frame
from . import oracle as O
from .q_reports import _daily_report_sql
from .registry import register

W = O.with_fixtures
CUSTOM = TF.DEFAULT_TARIFF.with_overrides(low_rate=2.1, block_rates=[4.0, 6.0, 8.0, 20.0], currency="EUR")


@register("is_low_tariff", W("""
SELECT reading_id, event_ts, {low} AS is_low FROM readings""".format(
    low=O.is_low(O.dow_sun1("event_ts"), "CAST(hour(event_ts) AS INTEGER)"))), "tariff")
def q_is_low_tariff(spark, sf):
    r = fx.readings(spark, sf)
    return r.select("reading_id", "event_ts", TF.is_low_tariff(F.col("event_ts")).alias("is_low"))


@register("block_cost", W(f"""
SELECT reading_id, today_kwh, power_w, {O.block_cost('today_kwh')} AS cost_from_zero,
       {O.block_cost('today_kwh', 'power_w')} AS cost_after_cum FROM meter_days"""), "tariff")
def q_block_cost(spark, sf):
    m = fx.meter_days(spark, sf)
    return m.select("reading_id", "today_kwh", "power_w",
                    TF.block_cost(F.col("today_kwh")).alias("cost_from_zero"),
                    TF.block_cost(F.col("today_kwh"), F.col("power_w")).alias("cost_after_cum"))


@register("effective_rate", W(f"""
SELECT reading_id, {O.effective_rate('today_kwh')} AS rate FROM meter_days"""), "tariff")
def q_effective_rate(spark, sf):
    m = fx.meter_days(spark, sf)
    return m.select("reading_id", TF.effective_rate(F.col("today_kwh")).alias("rate"))


def _reading_cost_sql(tariff):
    low = O.is_low(O.dow_sun1("event_ts"), "CAST(hour(event_ts) AS INTEGER)")
    c = O.reading_cost("today_kwh", low, tariff)
    return W(f"""
SELECT reading_id, {c['cost']} AS cost, {c['tariff_type']} AS tariff_type, {c['rate']} AS rate,
       {c['currency']} AS currency FROM readings WHERE has_energy""")


def _reading_cost(spark, sf, tariff):
    r = fx.readings(spark, sf).filter("has_energy")
    c = TF.reading_cost(F.col("today_kwh"), TF.is_low_tariff(F.col("event_ts")), tariff=tariff)
    return r.select("reading_id", *[v.alias(k) for k, v in c.items()])


register("reading_cost", _reading_cost_sql(TF.DEFAULT_TARIFF), "tariff")(
    lambda spark, sf: _reading_cost(spark, sf, TF.DEFAULT_TARIFF))
register("reading_cost_custom_rates", _reading_cost_sql(CUSTOM), "tariff")(
    lambda spark, sf: _reading_cost(spark, sf, CUSTOM))


@register("today_estimate", W("""
SELECT reading_id, {v} AS value, {cur} AS currency, {conf} AS confidence, {proj} AS projected_daily
FROM readings WHERE has_energy""".format(**dict(zip(
    ["v", "cur", "conf", "proj"],
    O.today_estimate("today_kwh", "CAST(hour(event_ts) AS INTEGER)").values())))), "tariff")
def q_today_estimate(spark, sf):
    r = fx.readings(spark, sf).filter("has_energy")
    e = TF.today_estimate(F.col("today_kwh"), F.hour("event_ts"))
    return r.select("reading_id", *[v.alias(k) for k, v in e.items()])


def _num_text(e: str) -> str:
    return (f"(CASE WHEN ({e}) IS NULL THEN NULL WHEN ({e}) = floor({e}) AND abs({e}) < 1e15 "
            f"THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END)")


@register("export_report_csv", "WITH dr AS (" + _daily_report_sql(False) + f""")
SELECT period_start, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS "Time",
       coalesce({_num_text('energy')}, '') AS "Energy (kWh)",
       coalesce({_num_text('peak_power')}, '') AS "Peak Power (W)",
       coalesce({_num_text('cost')}, '') AS "Cost", coalesce(tariff_type, '') AS "TariffType"
FROM dr""", "tariff")
def q_export_report_csv(spark, sf):
    return report_csv_frame(R.daily_report(fx.readings(spark, sf)))
