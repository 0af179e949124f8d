"""Registered series queries (A16, F6, F7, W3-W7, W9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import js_round
from ..operators import periods as P
from ..operators import series as S
from ..sources import fixtures as fx
from . import oracle as O
from .registry import AS_OF, register

W = O.with_fixtures
T = O.ts(AS_OF)
RECENT_HOURS = 48
RECENT_LIMIT = 10_000

_HM = f"""hm AS (
  SELECT CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {O.exact_avg('power_w')} AS value,
         count(*) AS count FROM readings WHERE power_w IS NOT NULL GROUP BY 1)"""
_HMD = f"""hmd AS (
  SELECT device_id, CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp,
         {O.exact_avg('power_w')} AS value, count(*) AS count
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1, 2)"""
_RECENT = f"""rr AS (
  SELECT * FROM (
    SELECT processing_ts AS timestamp, power_w AS value, reading_id, device_id FROM readings
    WHERE power_w IS NOT NULL AND processing_ts >= {T} - INTERVAL {RECENT_HOURS} HOUR
    ORDER BY processing_ts DESC, reading_id DESC LIMIT {RECENT_LIMIT}) t)"""
_ALL_RECENT = f"""ra AS (
  SELECT processing_ts AS timestamp, power_w AS value, reading_id, device_id FROM readings
  WHERE power_w IS NOT NULL AND processing_ts >= {T} - INTERVAL {RECENT_HOURS} HOUR)"""

register("hourly_mean", W("SELECT * FROM hm", _HM), "series")(
    lambda spark, sf: S.hourly_mean(fx.readings(spark, sf)))
register("hourly_mean_by_device", W("SELECT * FROM hmd", _HMD), "series")(
    lambda spark, sf: S.hourly_mean(fx.readings(spark, sf), by_device=True))
register("recent_readings", W("SELECT * FROM rr", _RECENT), "series")(
    lambda spark, sf: P.recent_readings(fx.readings(spark, sf), AS_OF, RECENT_HOURS, RECENT_LIMIT))


def _suff_sql(days_required: float) -> str:
    age = (f"coalesce(CAST(epoch_us({T}) - epoch_us(min(processing_ts)) AS DOUBLE) / 86400000000.0e0, 0.0e0)")
    prog = "100.0e0" if days_required == 0 else f"least(100.0e0, {age} / {float(days_required)!r}e0 * 100.0e0)"
    return W(f"""
SELECT {age} AS days_available, {float(days_required)!r}e0 AS days_required,
       {age} >= {float(days_required)!r}e0 AS is_sufficient, {O.js_round(prog, 1)} AS progress_percent
FROM readings WHERE power_w IS NOT NULL""")


register("data_sufficiency", _suff_sql(45), "series")(
    lambda spark, sf: P.data_sufficiency(fx.readings(spark, sf), AS_OF, 45))
register("data_sufficiency_default", _suff_sql(0), "series")(
    lambda spark, sf: P.data_sufficiency(fx.readings(spark, sf), AS_OF, 0))


def _rolling_sql(src: str, part: str, order: str, keys: str) -> str:
    w = f"({part}ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    s1 = f"CAST(sum(CAST(value AS DECIMAL(38,10))) OVER {w} AS DOUBLE)"
    s2 = f"CAST(sum(CAST(value * value AS DECIMAL(38,10))) OVER {w} AS DOUBLE)"
    k = f"CAST(count(value) OVER {w} AS DOUBLE)"
    std = O.js_round("CASE WHEN k > 1 THEN sqrt(greatest(0.0e0, (s2 - s1 * s1 / k) / (k - 1.0e0))) ELSE 0.0e0 END", 6)
    return f"""
SELECT {keys}timestamp, value, rolling_mean,
       {std} AS rolling_std,
       value - rolling_mean AS diff_from_mean
FROM (SELECT *, {s1} AS s1, {s2} AS s2, {k} AS k, {s1} / {k} AS rolling_mean FROM {src}) t"""


# rolling_std is compared at 6 decimals (last-bit differences between engines' sqrt inputs)
def _roll_cols():
    return ["timestamp", "value", "rolling_mean", js_round(F.col("rolling_std"), 6).alias("rolling_std"),
            "diff_from_mean"]

_SERIES = dict(order_cols=("timestamp", "reading_id"), partition_cols=("device_id",), block_rows=S.BLOCK_ROWS)

register("rolling_features", W(_rolling_sql("ra", "PARTITION BY device_id ", "timestamp, reading_id", "device_id, reading_id, "), _ALL_RECENT), "series")(
    lambda spark, sf: S.rolling_features(P.recent_readings(fx.readings(spark, sf), AS_OF, RECENT_HOURS),
                                         **_SERIES).select("device_id", "reading_id", *_roll_cols()))
register("rolling_features_by_device",
         W(_rolling_sql("hmd", "PARTITION BY device_id ", "timestamp", "device_id, "), _HMD), "series")(
    lambda spark, sf: S.rolling_features(S.hourly_mean(fx.readings(spark, sf), by_device=True),
                                         partition_cols=("device_id",)).select("device_id", *_roll_cols()))


def _expected_sql(src, part, order, keys):
    w = f"({part}ORDER BY {order} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"
    return f"""
SELECT {keys}timestamp, value, CAST(sum(CAST(value AS DECIMAL(38,10))) OVER {w} AS DOUBLE)
       / CAST(count(value) OVER {w} AS DOUBLE) AS expected FROM {src}"""


register("expected_value", W(_expected_sql("ra", "PARTITION BY device_id ", "timestamp, reading_id", "device_id, reading_id, "), _ALL_RECENT), "series")(
    lambda spark, sf: S.expected_value(P.recent_readings(fx.readings(spark, sf), AS_OF, RECENT_HOURS),
                                       **_SERIES).select("device_id", "reading_id", "timestamp", "value", "expected"))
register("expected_value_by_device",
         W(_expected_sql("hmd", "PARTITION BY device_id ", "timestamp", "device_id, "), _HMD), "series")(
    lambda spark, sf: S.expected_value(S.hourly_mean(fx.readings(spark, sf), by_device=True),
                                       partition_cols=("device_id",)).select("device_id", "timestamp", "value", "expected"))


def _cyc(fn, unit, n):
    return O.js_round(f"{fn}(6.283185307179586e0 * CAST({unit} AS DOUBLE) / {n})", 6)


@register("cyclic_time_features", W(f"""
SELECT reading_id, event_ts,
       {_cyc('sin', 'hour(event_ts)', 24)} AS hour_sin, {_cyc('cos', 'hour(event_ts)', 24)} AS hour_cos,
       {_cyc('sin', 'isodow(event_ts) - 1', 7)} AS dow_sin, {_cyc('cos', 'isodow(event_ts) - 1', 7)} AS dow_cos
FROM readings"""), "series")
def q_cyclic(spark, sf):
    r = S.cyclic_time_features(fx.readings(spark, sf).select("reading_id", "event_ts"), ts="event_ts")
    return r.select("reading_id", "event_ts", *[js_round(F.col(c), 6).alias(c)
                                                for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])


_SPLITS = _HM + """,
b AS (SELECT min(timestamp) AS t0, max(timestamp) AS t1,
             CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS span FROM hm),
kk AS (SELECT t0, CASE WHEN span < 7 THEN greatest(1, CAST(floor((span - 3) / 1) AS BIGINT)) ELSE 4 END AS k FROM b),
f AS (SELECT CAST(i AS INTEGER) AS fold0, t0 + to_days(CAST(3 + i AS INTEGER)) AS train_end,
             t0 + to_days(CAST(4 + i AS INTEGER)) AS val_end
      FROM kk, range(0, 16) r(i) WHERE i < k),
lng AS (
  SELECT f.fold0, 'train' AS role, hm.timestamp, hm.value, hm.count FROM f JOIN hm ON hm.timestamp < f.train_end
  UNION ALL
  SELECT f.fold0, 'validation', hm.timestamp, hm.value, hm.count FROM f JOIN hm
    ON hm.timestamp >= f.train_end AND hm.timestamp < f.val_end),
good AS (SELECT fold0, dense_rank() OVER (ORDER BY fold0) AS fold FROM lng GROUP BY fold0
         HAVING count(*) FILTER (WHERE role = 'train') > 0 AND count(*) FILTER (WHERE role = 'validation') > 0),
splits AS (SELECT CAST(g.fold AS INTEGER) AS fold, role, timestamp, value, count FROM lng JOIN good g USING (fold0))"""


def _splits(spark, sf):
    return S.expanding_splits(S.hourly_mean(fx.readings(spark, sf)))


register("expanding_splits", W("SELECT * FROM splits", _SPLITS), "series")(_splits)


@register("fold_info", W("""
SELECT fold, count(*) FILTER (WHERE role = 'train') AS train_size,
       count(*) FILTER (WHERE role = 'validation') AS val_size,
       min(CASE WHEN role = 'train' THEN timestamp END) AS train_start, max(CASE WHEN role = 'train' THEN timestamp END) AS train_end,
       min(CASE WHEN role = 'validation' THEN timestamp END) AS val_start, max(CASE WHEN role = 'validation' THEN timestamp END) AS val_end
FROM splits GROUP BY fold""", _SPLITS), "series")
def q_fold_info(spark, sf):
    return S.fold_info(_splits(spark, sf))


@register("first_per_hour", W("""
SELECT CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp,
       min_by(power_w, (processing_ts, reading_id)) AS value, min_by(reading_id, (processing_ts, reading_id)) AS reading_id
FROM readings WHERE power_w IS NOT NULL GROUP BY 1"""), "series")
def q_first_per_hour(spark, sf):
    r = fx.readings(spark, sf).filter(F.col("power_w").isNotNull()) \
        .select(F.col("processing_ts").alias("timestamp"), F.col("power_w").alias("value"), "reading_id")
    return S.first_per_hour(r.withColumn("_o", F.struct("timestamp", "reading_id")), ts="timestamp") \
        .select("timestamp", "value", "reading_id")
