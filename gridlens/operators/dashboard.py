"""Dashboard summaries relative to an explicit ``as_of``.

The reference answers one household with a single faceted pipeline; here
each summary is a plan of its own, and ``generate_dashboard`` reduces the 7-day frame to
cells of processing date and event hour in one pass, from which all summaries add up.  With
``by_device=True`` every summary is computed per device, which is the form
that scales to a fleet: all grouping keys then include ``device_id`` and every
window is partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import js_number_text
from ..functions.rounding import exact_avg, exact_sum, half_even, js_round
from ..functions.tariff import DEFAULT_TARIFF, Tariff, confidence, is_low_tariff, reading_cost, today_estimate
from ..session import saved
from .periods import _ts, filter_devices

# Look-back windows of the dashboard.
RECENT_DAYS = 7
HOURLY_LOOKBACK_H = 25   # one extra hour as the baseline of the first delta

# Metric name -> readings column (absent columns read as NULL).
LATEST_METRICS = [
    ("power", "power_w"), ("voltage", "voltage_v"), ("current", "current_a"),
    ("energy_today", "today_kwh"), ("power_factor", "power_factor"),
    ("apparent_power", "apparent_power_va"), ("reactive_power", "reactive_power_var"),
    ("energy_total", "total_kwh"),
]


def _k(by_device):
    return ["device_id"] if by_device else []


def recent_frame(readings: DataFrame, as_of, device_id=None, device_type=None) -> DataFrame:
    """Rows processed in the 7 days up to ``as_of`` after the device filters."""
    t = _ts(as_of)
    df = filter_devices(readings, device_id, device_type)
    return df.filter((F.col("processing_ts") >= t - F.make_dt_interval(days=F.lit(RECENT_DAYS)))
                     & (F.col("processing_ts") <= t))


def _col_or_null(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _metrics(df: DataFrame) -> F.Column:
    return F.struct(F.col("has_energy"), F.col("processing_ts"), *[_col_or_null(df, c).alias(m) for m, c in LATEST_METRICS])


_NEWEST = ("processing_ts", "reading_id")


def dashboard_latest(readings: DataFrame, as_of, by_device: bool = False, **filters) -> DataFrame:
    """Newest reading's metrics as text (``'0'`` when NULL or when it has no ENERGY)."""
    df = recent_frame(readings, as_of, **filters)
    return _latest(df.groupBy(*_k(by_device)).agg(F.max_by(_metrics(df), F.struct(*_NEWEST)).alias("r")), by_device)


def _latest(latest: DataFrame, by_device: bool) -> DataFrame:
    out = [F.when(F.col("r.has_energy"), F.coalesce(js_number_text(F.col(f"r.{m}")), F.lit("0")))
           .otherwise(F.lit("0")).alias(m) for m, _ in LATEST_METRICS]
    return latest.select(*_k(by_device), *out, F.col("r.processing_ts").alias("processing_ts"))


def meter_delta_baseline(df: DataFrame, value: str, order_by, partition_by=(), out: str = "consumption") -> DataFrame:
    """Per-step consumption where the first row is only the baseline (dropped).

    NULL energy counts as 0; a drop counts the new value; result rounded to 2.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    cur = F.coalesce(F.col(value), F.lit(0.0))
    prev = F.lag(cur).over(w)
    delta = F.when(cur < prev, cur).otherwise(F.greatest(F.lit(0.0), cur - prev))
    return (df.withColumn("_n", F.row_number().over(w))
              .withColumn(out, js_round(delta, 2))
              .filter(F.col("_n") > 1).drop("_n"))


def dashboard_hourly(readings: DataFrame, as_of, by_device: bool = False, **filters) -> DataFrame:
    """Last 25 h by processing time, bucketed by event hour; consumption per hour.

    Avg/peak power are rounded half-to-even to 1 decimal; the first bucket is
    only the baseline of the first delta.
    """
    t = _ts(as_of)
    df = recent_frame(readings, as_of, **filters) \
        .filter(F.col("processing_ts") >= t - F.make_dt_interval(hours=F.lit(HOURLY_LOOKBACK_H)))
    b = df.groupBy(*_k(by_device), F.date_trunc("hour", "event_ts").alias("timestamp")).agg(
        exact_avg("power_w").alias("avg_power"), F.max("power_w").alias("max_power"),
        F.max("today_kwh").alias("energy"))
    return _hourly(b, by_device)


def _hourly(b: DataFrame, by_device: bool) -> DataFrame:
    b = b.select(*_k(by_device), "timestamp", half_even(F.col("avg_power"), 1).alias("power"),
                 half_even(F.col("max_power"), 1).alias("peak_power"), "energy")
    return meter_delta_baseline(b, "energy", ["timestamp"], _k(by_device)) \
        .select(*_k(by_device), "timestamp", "power", "peak_power", "consumption")


def dashboard_daily(readings: DataFrame, as_of, by_device: bool = False, **filters) -> DataFrame:
    """Per processing date of the last 7 days: avg/max/min power, max counter, count."""
    df = recent_frame(readings, as_of, **filters)
    return df.groupBy(*_k(by_device), F.to_date("processing_ts").alias("date")).agg(
        exact_avg("power_w").alias("avg_power"), F.max("power_w").alias("max_power"),
        F.min("power_w").alias("min_power"),
        F.coalesce(F.max("today_kwh"), F.lit(0.0)).alias("energy_consumed"),
        F.count(F.lit(1)).alias("reading_count"))


def dashboard_today(readings: DataFrame, as_of, by_device: bool = False, limit: int | None = None, **filters) -> DataFrame:
    """Readings since the start of ``as_of``'s day, ascending and numbered.

    ``seq`` (per device with ``by_device``) is a row's place in its second (a
    device's hour) plus the rows before it, so no window spans the fleet's raw rows.  ``limit`` keeps the first so many; the
    display that this feeds asks for 1440.
    """
    t = _ts(as_of)
    df = recent_frame(readings, as_of, **filters).filter(F.col("processing_ts") >= F.date_trunc("day", t))
    ts = F.coalesce("time_utc", "payload_ts", "processing_ts") if "time_utc" in df.columns else F.coalesce("payload_ts", "processing_ts")
    rows = df.select(*_k(by_device), "processing_ts", "reading_id", ts.alias("timestamp"),
                     F.col("power_w").alias("power"), F.col("voltage_v").alias("voltage"),
                     F.col("today_kwh").alias("energy"), F.date_trunc("hour" if by_device else "second", "processing_ts").alias("_hour"))
    keys = _k(by_device)
    if limit is not None and not by_device:
        rows = rows.orderBy("processing_ts", "reading_id").limit(limit)
    hours = rows.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = hours.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_hour").alias("_s_hour"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_hour") == F.col("_s_hour")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_hour").orderBy("processing_ts", "reading_id"))
    out = rows.withColumn("_place", place).join(starts, same).withColumn("seq", (F.col("_place") + F.col("_start")).cast("int"))
    if limit is not None:
        out = out.filter(F.col("seq") <= limit)
    return out.select(*keys, "seq", "timestamp", "power", "voltage", "energy")


def dashboard_cost(hourly: DataFrame, latest: DataFrame, as_of, tariff: Tariff = DEFAULT_TARIFF,
                   by_device: bool = False) -> DataFrame:
    """today's cost from the hourly consumption, else the 60/40 estimate.

    ``hourly`` is A12, ``latest`` is A11 (for the fallback's energy today).
    Confidence follows the hour of ``as_of``; projection = total / hour * 24.
    """
    t = _ts(as_of)
    hour = F.hour(t)
    priced = hourly.withColumn("cost", reading_cost(F.col("consumption"), is_low_tariff(F.col("timestamp")),
                                                    tariff=tariff)["cost"])
    tot = priced.groupBy(*_k(by_device)).agg(exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("n_hours"))
    base = latest.select(*_k(by_device), F.col("energy_today").cast("double").alias("energy_today"))
    if by_device:
        j = base.join(tot, _k(by_device), "left")
    else:  # one household: both sides are single global aggregates -> scalar subqueries
        t = tot.select(F.struct("total", "n_hours")).scalar()
        j = base.select("energy_today", t.getField("total").alias("total"), t.getField("n_hours").alias("n_hours"))
    est = today_estimate(F.coalesce(F.col("energy_today"), F.lit(0.0)), hour, tariff)
    has = F.coalesce(F.col("n_hours"), F.lit(0)) > 0
    return j.select(
        *_k(by_device),
        F.when(has, js_round(F.col("total"), 2)).otherwise(est["value"]).alias("value"),
        F.lit(tariff.currency).alias("currency"),
        F.when(has, confidence(hour)).otherwise(est["confidence"]).alias("confidence"),
        F.when(has, F.when(hour > 0, js_round(F.col("total") / hour * F.lit(24.0), 2)).otherwise(F.col("total")))
         .otherwise(est["projected_daily"]).alias("projected_daily"),
    )


def dashboard_cells(readings: DataFrame, as_of, **filters) -> DataFrame:
    """The 7-day frame by device, processing date, event hour and whether a row is of the last 25 hours.

    Per cell: exact power sum and counts, extremes, and the newest reading: all that A11-A13 add up.
    """
    df = recent_frame(readings, as_of, **filters)
    last = F.col("processing_ts") >= _ts(as_of) - F.make_dt_interval(hours=F.lit(HOURLY_LOOKBACK_H))
    return df.groupBy("device_id", F.to_date("processing_ts").alias("date"), F.date_trunc("hour", "event_ts").alias("timestamp"), last.alias("recent")).agg(
        F.sum(F.col("power_w").cast("decimal(38,10)")).alias("power_sum"), F.count("power_w").alias("power_count"), F.max("power_w").alias("max_power"),
        F.min("power_w").alias("min_power"), F.max("today_kwh").alias("energy"), F.count(F.lit(1)).alias("rows"),
        F.max(F.struct(*_NEWEST)).alias("newest"), F.max_by(_metrics(df), F.struct(*_NEWEST)).alias("r"))


def generate_dashboard(readings: DataFrame, as_of, device_id: str | None = None, device_type: str | None = None,
                       tariff: Tariff = DEFAULT_TARIFF, by_device: bool = False) -> dict:
    """All dashboard answers of one request: ``latest``, ``hourly``, ``daily``, ``today``, ``cost``.

    The 7-day frame is scanned once, for a small stored table of cells that all
    summaries add up; only ``today`` reads raw rows, those of its day.
    """
    filters = {"device_id": device_id, "device_type": device_type}
    cells = saved(dashboard_cells(readings, as_of, **filters), "dashboard")
    k = _k(by_device)
    power = F.sum("power_sum").cast("double") / F.sum("power_count").cast("double")
    latest = _latest(cells.groupBy(*k).agg(F.max_by("r", "newest").alias("r")), by_device)
    hourly = _hourly(cells.filter("recent").groupBy(*k, "timestamp").agg(
        F.when(F.sum("power_count") > 0, power).alias("avg_power"), F.max("max_power").alias("max_power"), F.max("energy").alias("energy")), by_device)
    daily = cells.groupBy(*k, "date").agg(F.when(F.sum("power_count") > 0, power).alias("avg_power"), F.max("max_power").alias("max_power"), F.min("min_power").alias("min_power"),
                                          F.coalesce(F.max("energy"), F.lit(0.0)).alias("energy_consumed"), F.sum("rows").alias("reading_count"))
    return {
        "latest": latest,
        "hourly": hourly,
        "daily": daily,
        "today": dashboard_today(readings, as_of, by_device, **filters),
        "cost": dashboard_cost(hourly, latest, as_of, tariff, by_device),
    }
