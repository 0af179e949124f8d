"""Registered model queries: anomaly detection (M1-M7) and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.quantiles import exact_percentiles
from ..functions.rounding import exact_avg, js_round
from ..operators import anomaly as M
from ..operators import forecast as FC
from ..operators import periods as P
from ..operators import series as S
from ..session import saved
from ..sources import fixtures as fx
from . import oracle as O
from . import q_series
from .registry import AS_OF, register

W = O.with_fixtures
TRAIN_HOURS, DETECT_HOURS = 168, 24
SENSITIVITY = 0.8
ORDER = ("timestamp", "reading_id")


#: Features are per device, over all readings of the period.
SERIES = dict(order_cols=ORDER, partition_cols=("device_id",), block_rows=S.BLOCK_ROWS)


def _recent(spark, sf, hours):
    return P.recent_readings(fx.readings(spark, sf), AS_OF, hours)


def _stored_readings(spark, sf):
    """Readings as models find them, in a table: the fixture's own derivation stands in the plan once."""
    needed = ("reading_id", "device_id", "processing_ts", "power_w")
    return saved(fx.readings(spark, sf).select(*needed), "readings")


def _train_features(readings):
    return M.anomaly_features(P.recent_readings(readings, AS_OF, TRAIN_HOURS), **SERIES).withColumnRenamed("reading_id", "row_key")


# ------------------------------------------------------------------ M1 (oracle, 6-decimal rounding)
_RR = f"""rr AS (
  SELECT processing_ts AS timestamp, power_w AS value, reading_id, device_id FROM readings
  WHERE power_w IS NOT NULL AND processing_ts >= {O.ts(AS_OF)} - INTERVAL {TRAIN_HOURS} HOUR),
fw AS (
  SELECT *, CAST(sum(CAST(value AS DECIMAL(38,10))) OVER w AS DOUBLE) AS s1,
         CAST(sum(CAST(value * value AS DECIMAL(38,10))) OVER w AS DOUBLE) AS s2,
         CAST(count(value) OVER w AS DOUBLE) AS k
  FROM rr WINDOW w AS (PARTITION BY device_id ORDER BY timestamp, reading_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _r6(e):
    return O.js_round(e, 6)


@register("anomaly_features", W(f"""
SELECT reading_id, timestamp, value, s1 / k AS rolling_mean,
       {_r6('CASE WHEN k > 1 THEN sqrt(greatest(0.0e0, (s2 - s1 * s1 / k) / (k - 1.0e0))) ELSE 0.0e0 END')} AS rolling_std,
       value - s1 / k AS diff_from_mean,
       {_r6('sin(6.283185307179586e0 * CAST(hour(timestamp) AS DOUBLE) / 24)')} AS hour_sin,
       {_r6('cos(6.283185307179586e0 * CAST(hour(timestamp) AS DOUBLE) / 24)')} AS hour_cos,
       {_r6('sin(6.283185307179586e0 * CAST(isodow(timestamp) - 1 AS DOUBLE) / 7)')} AS dow_sin,
       {_r6('cos(6.283185307179586e0 * CAST(isodow(timestamp) - 1 AS DOUBLE) / 7)')} AS dow_cos
FROM fw""", _RR), "anomaly")
def q_anomaly_features(spark, sf):
    f = M.anomaly_features(_recent(spark, sf, TRAIN_HOURS), **SERIES)
    r6 = ("rolling_std", "hour_sin", "hour_cos", "dow_sin", "dow_cos")
    return f.select("reading_id", "timestamp", "value", "rolling_mean", "diff_from_mean",
                    *[js_round(F.col(c), 6).alias(c) for c in r6])


# ------------------------------------------------------------------ M2 / P5 (oracle: the same draws, trees grown by levels)
def _draw_unit(*parts):
    return draw_sql(*parts)


def _grow_sql(trees: int, mfs: list, seed: int = 42) -> str:
    """CTEs up to ``nodes`` (mf, tree, node, feature, threshold, leaf_size, depth) and ``tf`` (the training rows)."""
    f = M.FEATURES
    array = "[" + ", ".join(f) + "]"
    want = float(M.forest.OVERSAMPLE * M.forest.MAX_SAMPLES)
    subset = "list_transform(list_sort([" + ", ".join(f"struct_pack(u := {_draw_unit(seed, M.forest.SUBSET, 'tree', j)}, j := {j})" for j in range(len(f))) + "]), lambda x: x.j)"
    parts = [_RR, f"""tf AS (
  SELECT reading_id AS rk, s1 / k AS rolling_mean, CASE WHEN k > 1 THEN sqrt(greatest(0.0e0, (s2 - s1 * s1 / k) / (k - 1.0e0))) ELSE 0.0e0 END AS rolling_std,
         value, value - s1 / k AS diff_from_mean,
         sin(6.283185307179586e0 * CAST(hour(timestamp) AS DOUBLE) / 24) AS hour_sin, cos(6.283185307179586e0 * CAST(hour(timestamp) AS DOUBLE) / 24) AS hour_cos,
         sin(6.283185307179586e0 * CAST(isodow(timestamp) - 1 AS DOUBLE) / 7) AS dow_sin, cos(6.283185307179586e0 * CAST(isodow(timestamp) - 1 AS DOUBLE) / 7) AS dow_cos
  FROM fw)""", f"""size AS (SELECT n, least(1.0e0, {trees * want!r}e0 / n) AS q FROM (SELECT count(*) AS n FROM tf)),
cand AS (
  SELECT tree, rk, {array} AS f, {_draw_unit(seed, M.forest.SAMPLE, 'tree + 1', 'rk')} AS h
  FROM (SELECT tf.*, unnest(generate_series(0, {trees - 1})) AS tree, size.n, size.q FROM tf, size WHERE size.n >= 48 AND {_draw_unit(seed, M.forest.SAMPLE, 'rk')} < size.q) x
  WHERE h < least(1.0e0, {want!r}e0 / (q * n))),
sample AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY tree ORDER BY h, rk) <= 256),
lev0 AS MATERIALIZED (
  SELECT mf, tree, f, 0 AS node, false AS done, len(list_filter([1, 2, 4, 8, 16, 32, 64, 128], lambda p: p < greatest(2, count(*) OVER (PARTITION BY mf, tree)))) AS lim,
         ({subset})[1:greatest(1, CAST(floor(mf * {len(f)}) AS BIGINT))] AS subset
  FROM sample, (SELECT unnest([{', '.join(O.lit(m) for m in mfs)}]) AS mf))"""]
    for d in range(M.forest.LEVELS + 1):
        least = ", ".join(f"min(f[{j + 1}]) OVER w" for j in range(len(f)))
        most = ", ".join(f"max(f[{j + 1}]) OVER w" for j in range(len(f)))
        parts.append(f"""box{d} AS (SELECT *, count(*) OVER w AS n, [{least}] AS lo, [{most}] AS hi FROM lev{d} WINDOW w AS (PARTITION BY mf, tree, node)),
use{d} AS (SELECT *, list_filter(list_sort(subset), lambda j: hi[j + 1] > lo[j + 1]) AS usable FROM box{d}),
pick{d} AS (
  SELECT *, CASE WHEN NOT done AND n > 1 AND {d} < lim AND len(usable) > 0
                 THEN usable[CAST(floor({_draw_unit(42, M.forest.PICK, 'tree', 'node')} * len(usable)) AS BIGINT) + 1] ELSE -1 END AS feature FROM use{d}),
cut{d} AS MATERIALIZED (
  SELECT *, CASE WHEN feature >= 0 THEN lo[feature + 1] + {_draw_unit(42, M.forest.CUT, 'tree', 'node')} * (hi[feature + 1] - lo[feature + 1]) ELSE 0.0e0 END AS threshold FROM pick{d}),
lev{d + 1} AS MATERIALIZED (
  SELECT mf, tree, f, CASE WHEN feature < 0 THEN node WHEN f[feature + 1] < threshold THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, feature < 0 AS done, lim, subset FROM cut{d})""")
    union = " UNION ALL ".join(f"SELECT DISTINCT mf, tree, node, feature, threshold, CASE WHEN feature < 0 THEN n ELSE 0 END AS leaf_size, {d} AS depth FROM cut{d} WHERE NOT done"
                               for d in range(M.forest.LEVELS + 1))
    parts.append(f"nodes AS MATERIALIZED ({union})")
    return ",\n".join(parts)


def _paths_sql(rows: str = "tf") -> str:
    """CTEs up to ``paths`` (mf, tree, k, path): every row walked down every tree; a missing child is an empty leaf."""
    f = M.FEATURES
    parts = [f"walk0 AS (SELECT t.mf, t.tree, r.rk AS k, [{', '.join('r.' + c for c in f)}] AS f, 0 AS node, false AS still FROM {rows} r, (SELECT DISTINCT mf, tree FROM nodes) t)"]
    for d in range(M.forest.LEVELS):
        parts.append(f"""walk{d + 1} AS (
  SELECT w.mf, w.tree, w.k, w.f, CASE WHEN w.still OR coalesce(n.feature, -1) < 0 THEN w.node WHEN w.f[n.feature + 1] < n.threshold THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END AS node,
         w.still OR coalesce(n.feature, -1) < 0 AS still
  FROM walk{d} w LEFT JOIN nodes n ON n.mf = w.mf AND n.tree = w.tree AND n.node = w.node)""")
    c = "CASE WHEN s > 2 THEN 2.0e0 * (ln(s - 1.0e0) + 0.5772156649015329e0) - 2.0e0 * (s - 1.0e0) / s WHEN s = 2 THEN 1.0e0 ELSE 0.0e0 END"
    parts.append(f"""paths AS MATERIALIZED (
  SELECT mf, tree, k, floor(log2(node + 1)) + {c} AS path
  FROM (SELECT w.mf, w.tree, w.k, w.node, CAST(coalesce(n.leaf_size, 0) AS DOUBLE) AS s
        FROM walk{M.forest.LEVELS} w LEFT JOIN nodes n ON n.mf = w.mf AND n.tree = w.tree AND n.node = w.node) x)""")
    return ",\n".join(parts)


def _raw_sql(n: int | str) -> str:
    return f"-pow(2.0e0, -avg(path) FILTER (WHERE tree < {n}) / {O.lit(float(M.forest.average_path_length([M.forest.MAX_SAMPLES])[0]))})"


FIT_TREES = 100


@register("fit_isolation_forest", W(f"""
SELECT tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, {_r6('threshold')} AS threshold,
       CAST(CASE WHEN feature >= 0 THEN 2 * node + 1 ELSE -1 END AS INTEGER) AS left, CAST(CASE WHEN feature >= 0 THEN 2 * node + 2 ELSE -1 END AS INTEGER) AS right,
       CAST(leaf_size AS INTEGER) AS leaf_size, depth FROM nodes
UNION ALL SELECT -1, 0, -1, {_r6('quantile_cont(raw, 0.01e0)')}, -1, -1, 0, 0 FROM (SELECT k, {_raw_sql(FIT_TREES)} AS raw FROM paths GROUP BY k) HAVING count(*) > 0""",
                                   _grow_sql(FIT_TREES, [1.0]) + ",\n" + _paths_sql()), "anomaly")
def q_fit_forest(spark, sf):
    """Nodes of 100 trees, and the offset of the default contamination."""
    return _fitted(_stored_readings(spark, sf)).withColumn("threshold", js_round(F.col("threshold"), 6))


def _fitted(readings):
    return M.fit_isolation_forest(_train_features(readings), FIT_TREES, M.DEFAULT_CONTAMINATION)


@register("score_isolation_forest", None, "anomaly")
def q_score_forest(spark, sf):
    readings = _stored_readings(spark, sf)
    feats = M.anomaly_features(P.recent_readings(readings, AS_OF, DETECT_HOURS), **SERIES)
    return M.score_isolation_forest(feats, _fitted(readings)).select("reading_id", "timestamp", "value", "raw_score", "decision", "is_outlier", "anomaly_score")


@register("detect_anomalies", None, "anomaly")
def q_detect(spark, sf):
    readings = _stored_readings(spark, sf)
    return M.detect_anomalies(P.recent_readings(readings, AS_OF, DETECT_HOURS), _fitted(readings), SENSITIVITY, **SERIES)


# ------------------------------------------------------------------ M3 / M5 on a fixed forest (oracle)
#: (tree, node, feature, threshold, left, right, leaf size, depth); nodes as in a heap, features by place in M.FEATURES.
FIXED_FOREST = [
    (0, 0, 0, 400.0, 1, 2, 0, 0), (0, 1, -1, 0.0, -1, -1, 3, 1), (0, 2, 7, 25.5, 5, 6, 0, 1), (0, 5, -1, 0.0, -1, -1, 5, 2), (0, 6, -1, 0.0, -1, -1, 1, 2),
    (1, 0, 7, 0.0, 1, 2, 0, 0), (1, 1, -1, 0.0, -1, -1, 10, 1), (1, 2, 0, 250.0, 5, 6, 0, 1), (1, 5, -1, 0.0, -1, -1, 2, 2), (1, 6, -1, 0.0, -1, -1, 60, 2),
]


def _path_sql(tree: int, node: int = 0) -> str:
    """Path length of one tree as nested CASE expressions over the feature columns."""
    _, _, feature, threshold, left, right, size, depth = next(n for n in FIXED_FOREST if n[:2] == (tree, node))
    if feature < 0:
        return O.lit(depth + float(M.forest.average_path_length([size])[0]))
    return f"CASE WHEN {M.FEATURES[feature]} < {O.lit(threshold)} THEN {_path_sql(tree, left)} ELSE {_path_sql(tree, right)} END"


_FIXED = f"""hmd AS (
  SELECT device_id, CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {O.exact_avg('power_w')} AS value
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1, 2),
ft AS (
  SELECT *, value - CAST(sum(CAST(value AS DECIMAL(38,10))) OVER w AS DOUBLE) / CAST(count(value) OVER w AS DOUBLE) AS diff_from_mean,
         CAST(sum(CAST(value AS DECIMAL(38,10))) OVER e AS DOUBLE) / CAST(count(value) OVER e AS DOUBLE) AS expected
  FROM hmd WINDOW w AS (PARTITION BY device_id ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                  e AS (PARTITION BY device_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
sc AS (SELECT *, -pow(2.0e0, -(({_path_sql(0)}) + ({_path_sql(1)})) / 2.0e0 / {O.lit(float(M.forest.average_path_length([M.forest.MAX_SAMPLES])[0]))}) AS raw_score FROM ft),
an0 AS (SELECT *, 1.0e0 - (raw_score - (SELECT min(raw_score) FROM sc)) / (SELECT max(raw_score) - min(raw_score) FROM sc) AS anomaly_score,
               raw_score + 0.5e0 < 0 AS is_outlier FROM sc)"""


def _fixed_input(spark, sf):
    hourly = S.hourly_mean(fx.readings(spark, sf), by_device=True).select("device_id", "timestamp", "value")
    return hourly, spark.createDataFrame(FIXED_FOREST, M.forest.NODE_SCHEMA)


@register("score_fixed_forest", W(f"""
SELECT device_id, timestamp, value, {_r6('raw_score')} AS raw_score, {_r6('anomaly_score')} AS anomaly_score, is_outlier FROM an0""", _FIXED), "anomaly")
def q_score_fixed(spark, sf):
    hourly, forest = _fixed_input(spark, sf)
    out = M.score_isolation_forest(M.anomaly_features(hourly, partition_cols=("device_id",)), forest)
    return out.select("device_id", "timestamp", "value", js_round(F.col("raw_score"), 6).alias("raw_score"),
                      js_round(F.col("anomaly_score"), 6).alias("anomaly_score"), "is_outlier")


@register("detect_fixed_forest", W(f"""
SELECT timestamp, value AS actual_power, expected AS expected_power, {_r6('anomaly_score')} AS anomaly_score,
       CASE WHEN value > expected * 1.5e0 THEN 'spike' WHEN value < expected * 0.5e0 THEN 'dip' ELSE 'pattern_change' END AS anomaly_type
FROM an0 WHERE is_outlier AND abs(value - expected) >= 150.0e0
  AND anomaly_score > (SELECT greatest(0.7e0, quantile_cont(anomaly_score, 0.904e0)) FROM an0)""", _FIXED), "anomaly")
def q_detect_fixed(spark, sf):
    hourly, forest = _fixed_input(spark, sf)
    out = M.detect_anomalies(hourly, forest, SENSITIVITY, offset=M.AUTO_OFFSET, partition_cols=("device_id",))
    return out.withColumn("anomaly_score", js_round(F.col("anomaly_score"), 6))


# ------------------------------------------------------------------ M4-M7 on given scores (oracle)
_GS = f"""hmd AS (
  SELECT device_id, CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp,
         {O.exact_avg('power_w')} AS value
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1, 2),
gs AS (
  SELECT device_id, timestamp, value,
         CAST(sum(CAST(value AS DECIMAL(38,10))) OVER w AS DOUBLE) / CAST(count(value) OVER w AS DOUBLE) AS expected,
         value / (SELECT max(value) FROM hmd) AS anomaly_score,
         value / (SELECT max(value) FROM hmd) >= 0.5e0 AS is_outlier
  FROM hmd
  WINDOW w AS (PARTITION BY device_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
thr AS (SELECT greatest(0.7e0, quantile_cont(anomaly_score, 0.904e0)) AS threshold FROM gs),
an AS (
  SELECT timestamp, value AS actual_power, expected AS expected_power, anomaly_score,
         CASE WHEN value > expected * 1.5e0 THEN 'spike' WHEN value < expected * 0.5e0 THEN 'dip'
              ELSE 'pattern_change' END AS anomaly_type
  FROM gs WHERE is_outlier AND anomaly_score > (SELECT threshold FROM thr) AND abs(value - expected) >= 150.0e0)"""


def _given(spark, sf):
    """Deterministic scores on per-device hourly means: score = value / max value, outlier if >= 0.5."""
    hm = S.hourly_mean(fx.readings(spark, sf), by_device=True)
    hm = S.expected_value(hm, "value", ("timestamp",), ("device_id",))
    mx = hm.agg(F.max("value")).scalar()
    return hm.select("device_id", "timestamp", "value", "expected",
                     (F.col("value") / mx).alias("anomaly_score"), ((F.col("value") / mx) >= 0.5).alias("is_outlier"))


def _given_anoms(spark, sf):
    g = _given(spark, sf)
    return M.classify_anomalies(g, M.anomaly_threshold(g, SENSITIVITY).scalar())


register("anomaly_threshold", W("SELECT threshold FROM thr", _GS), "anomaly")(
    lambda spark, sf: M.anomaly_threshold(_given(spark, sf), SENSITIVITY))
register("classify_anomalies", W("SELECT * FROM an", _GS), "anomaly")(_given_anoms)
register("anomaly_summary", W(f"""
SELECT count(*) AS total_count,
       CASE WHEN count(*) = 0 THEN 'low'
            WHEN count(*) > 20 OR {O.exact_avg('anomaly_score')} > 0.8e0 THEN 'high'
            WHEN count(*) > 10 OR {O.exact_avg('anomaly_score')} > 0.6e0 THEN 'medium' ELSE 'low' END AS severity
FROM an""", _GS), "anomaly")(lambda spark, sf: M.anomaly_summary(_given_anoms(spark, sf)))
register("anomaly_view", W("""
SELECT timestamp, actual_power, expected_power, anomaly_score, anomaly_type,
       sign((actual_power - expected_power) / expected_power * 100.0e0)
         * floor(abs((actual_power - expected_power) / expected_power * 100.0e0) * 10.0e0 + 0.5e0) / 10.0e0 AS deviation_pct,
       sign(anomaly_score * 100.0e0) * floor(abs(anomaly_score * 100.0e0) * 1.0e0 + 0.5e0) / 1.0e0 AS score_pct,
       CASE WHEN anomaly_score > 0.9e0 THEN 'high' WHEN anomaly_score > 0.7e0 THEN 'medium' ELSE 'low' END AS band
FROM an""", _GS), "anomaly")(lambda spark, sf: M.anomaly_view(_given_anoms(spark, sf)))
register("anomaly_type_counts", W("""
SELECT count(*) FILTER (WHERE anomaly_type = 'spike') AS spikes, count(*) FILTER (WHERE anomaly_type = 'dip') AS dips,
       count(*) FILTER (WHERE anomaly_type = 'pattern_change') AS patterns FROM an""", _GS), "anomaly")(
    lambda spark, sf: M.anomaly_type_counts(_given_anoms(spark, sf)))


# ------------------------------------------------------------------ P1-P5

FC_HOURS, FC_PAST = 24, 6
VIEW_AS_OF = "2024-01-15 12:30:00"


#: The model of all devices together is trained on the hourly means of the last seven days.
WEEK_START = "2024-01-24 00:00:00"


def _global_model(spark, sf):
    hm = S.hourly_mean(fx.readings(spark, sf), start=WEEK_START)
    return hm, FC.fit_forecast(hm)


register("fit_forecast", None, "forecast")(lambda spark, sf: _global_model(spark, sf)[1])


def _device_models(spark, sf):
    """One row per device, trained on its whole hourly history (no test device has 48 hours with data in a week)."""
    readings = fx.readings(spark, sf)
    hm = S.hourly_mean(readings, by_device=True)
    # a row without a value for every device: those without any mean get a row, too
    devices = readings.select("device_id").distinct()
    return FC.fit_forecast(hm.unionByName(devices, allowMissingColumns=True), keys=("device_id",))


register("fit_forecast_by_device", None, "forecast")(_device_models)


@register("forecast", None, "forecast")
def q_forecast(spark, sf):
    _, model = _global_model(spark, sf)
    return FC.forecast(model, AS_OF, FC_HOURS, FC_PAST)


@register("forecast_by_device", None, "forecast")
def q_forecast_by_device(spark, sf):
    return FC.forecast(_device_models(spark, sf), AS_OF, FC_HOURS, FC_PAST, keys=("device_id",))


# the sums that P1 and P4 solve (oracle)
def _points_sql(rows: str, by: str = "") -> str:
    """Points in time order with their place, count, seconds since the first and second of the week."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY timestamp, value) - 1 AS place, count(*) OVER ({part}) AS n,
         (epoch_us(timestamp) // 1000000) - min(epoch_us(timestamp) // 1000000) OVER ({part}) AS u,
         (epoch_us(timestamp) // 1000000) % 604800 AS second
  FROM {rows}"""


def _places_sql(n: str) -> str:
    some = f"least(25, greatest({n} - 2, 0))"
    return (f"list_transform(generate_series(1, {some}), lambda i: CAST(round_even(i * (CAST(greatest(floor({n} * 0.8e0) - 1, 0) AS DOUBLE) / {some}), 0) AS BIGINT))")


_SUMS = f"""count(*) AS n, CAST(sum(u) AS DOUBLE) AS u, CAST(sum(CAST(u AS HUGEINT) * u) AS DOUBLE) AS uu,
  {O.js_round('CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE)', 4)} AS y, {O.js_round('CAST(sum(CAST(value * u AS DECIMAL(38,10))) AS DOUBLE)', 0)} AS uy,
  {O.js_round('CAST(sum(CAST(value * value AS DECIMAL(38,10))) AS DOUBLE)', 4)} AS yy, {O.js_round('max(abs(value))', 4)} AS y_max, CAST(max(u) AS BIGINT) AS u_max"""


def _rounded_sums(cells):
    return cells.withColumns({c: js_round(F.col(c), d) for c, d in (("y", 4), ("uy", 0), ("yy", 4), ("y_max", 4))})



_HMD = f"""hmd AS (
  SELECT device_id, CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {O.exact_avg('power_w')} AS value
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1, 2),
pts AS ({_points_sql('hmd', 'device_id')}),
seg AS (SELECT *, len(list_filter({_places_sql('n')}, lambda c: c < place)) AS segment FROM pts)"""

register("forecast_sums_by_device", W(f"SELECT device_id, CAST(segment AS INTEGER) AS segment, second, {_SUMS} FROM seg GROUP BY 1, 2, 3", _HMD), "forecast")(
    lambda spark, sf: _rounded_sums(FC.moment_cells(S.hourly_mean(fx.readings(spark, sf), by_device=True), ("device_id",))))

_FOLD_SUMS = q_series._SPLITS + f""",
sizes AS (SELECT fold, count(*) AS n FROM splits WHERE role = 'train' GROUP BY fold),
places AS (SELECT fold, n, {_places_sql('n')} AS places FROM sizes),
plan AS (SELECT list(struct_pack(fold := fold, n := n, places := places) ORDER BY fold) AS folds FROM places),
lastf AS (SELECT timestamp, value FROM splits WHERE role = 'train' AND fold = (SELECT max(fold) FROM splits)),
pts AS ({_points_sql('lastf')}),
seg AS (SELECT *, array_to_string(list_transform((SELECT folds FROM plan),
          lambda f: CASE WHEN place < f.n THEN len(list_filter(f.places, lambda c: c < place)) ELSE -1 END), ',') AS segments FROM pts)"""


@register("tune_forecast_sums", W(f"SELECT segments, second, {_SUMS} FROM seg GROUP BY 1, 2", _FOLD_SUMS), "forecast")
def q_tune_sums(spark, sf):
    """P4's sums: each training row once, by its segment in every fold."""
    cells, _ = FC.fold_cells(S.expanding_splits(S.hourly_mean(fx.readings(spark, sf))))
    return _rounded_sums(cells).withColumn("segments", F.array_join(F.transform("segments", lambda x: x.cast("string")), ","))


# P2 on given model rows (oracle): every device's own span and scale, fixed weights
_GIVEN = {"k": -0.15, "m": 0.55, "changepoints": [0.25, 0.6], "deltas": [0.3, -0.45], "periods": [1.0, 1.0, 7.0], "orders": [1, 2, 3],
          "beta_sin": [0.08, -0.03, 0.02], "beta_cos": [-0.06, 0.01, 0.04], "sigma": 0.05}
_GIVEN_MODES = ("additive", "multiplicative")


def _given_value_sql() -> str:
    """The given weights at times t (scaled) and d (days), spelled out term by term."""
    g = _GIVEN
    trend = f"{O.lit(g['k'])} * t + {O.lit(g['m'])} + (0.0e0" + "".join(f" + {O.lit(d)} * greatest(0.0e0, t - {O.lit(c)})" for c, d in zip(g["changepoints"], g["deltas"])) + ")"
    season = "0.0e0" + "".join(f" + ({O.lit(s)} * sin(6.283185307179586e0 * {o} * d / {O.lit(p)}) + {O.lit(c)} * cos(6.283185307179586e0 * {o} * d / {O.lit(p)}))"
                               for p, o, s, c in zip(g["periods"], g["orders"], g["beta_sin"], g["beta_cos"]))
    return f"CASE WHEN mode = 'multiplicative' THEN ({trend}) * (1.0e0 + ({season})) ELSE ({trend}) + ({season}) END * y_scale"


_FIXED_FC = f"""hmd AS (
  SELECT device_id, CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp, {O.exact_avg('power_w')} AS value
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1, 2),
models AS (
  SELECT device_id, min(timestamp) AS t0, max(timestamp) AS train_end, max(abs(value)) AS y_scale, count(*) >= 48 AS ok FROM hmd GROUP BY 1),
grid AS (
  SELECT device_id, timestamp FROM hmd JOIN models USING (device_id) WHERE ok
  UNION SELECT device_id, unnest(generate_series(train_end + INTERVAL 1 HOUR, {O.ts(AS_OF)} + INTERVAL {FC_HOURS} HOUR, INTERVAL 1 HOUR)) FROM models WHERE ok),
wanted AS (SELECT * FROM grid WHERE timestamp >= {O.ts(AS_OF)} - INTERVAL {FC_PAST} HOUR AND timestamp <= {O.ts(AS_OF)} + INTERVAL {FC_HOURS} HOUR),
fitted AS (
  SELECT device_id, mode, timestamp, y_scale, {_given_value_sql()} AS yhat
  FROM (SELECT w.device_id, w.timestamp, m.y_scale, u.mode,
               (CAST(epoch_us(w.timestamp) AS DOUBLE) / 1e6 - CAST(epoch_us(m.t0) AS DOUBLE) / 1e6) / (CAST(epoch_us(m.train_end) - epoch_us(m.t0) AS DOUBLE) / 1e6) AS t,
               CAST(epoch_us(w.timestamp) AS DOUBLE) / 1e6 / 86400.0e0 AS d
        FROM wanted w JOIN models m USING (device_id), (VALUES ('additive'), ('multiplicative')) u(mode)) x)"""


@register("forecast_given_model", W(f"""
SELECT device_id, mode, timestamp, {_r6('greatest(0.0e0, yhat)')} AS predicted_power,
       {_r6(f'greatest(0.0e0, yhat - {O.lit(FC.INTERVAL_Z)} * (0.05e0 * y_scale))')} AS lower_bound,
       {_r6(f'yhat + {O.lit(FC.INTERVAL_Z)} * (0.05e0 * y_scale)')} AS upper_bound, 'ok' AS status
FROM fitted
UNION ALL SELECT device_id, mode, NULL, NULL, NULL, NULL, 'short' FROM models, (VALUES ('additive'), ('multiplicative')) u(mode) WHERE NOT ok""", _FIXED_FC), "forecast")
def q_forecast_given(spark, sf):
    """P2 of every device on given weights, in both modes."""
    hm = S.hourly_mean(fx.readings(spark, sf), by_device=True)
    facts = hm.groupBy("device_id").agg(F.min("timestamp").alias("train_start"), F.max("timestamp").alias("train_end"), F.max(F.abs("value")).alias("y_scale"),
                                        F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_list("timestamp")).alias("history_ts"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6
    g = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in _GIVEN.items()}
    span = (F.unix_micros(F.col("train_end").cast("timestamp")) - F.unix_micros(F.col("train_start").cast("timestamp"))).cast("double") / 1e6
    models = facts.withColumns({**g, "sigma": g["sigma"] * F.col("y_scale"), "t0": seconds("train_start"), "t_span": span,
                                "status": F.when(F.col("n_points") >= FC.MIN_TRAINING_POINTS, FC.OK).otherwise(FC.SHORT),
                                "mode": F.explode(F.array(*map(F.lit, _GIVEN_MODES)))})
    out = FC.forecast(models, AS_OF, FC_HOURS, FC_PAST, keys=("device_id", "mode"))
    return out.select("device_id", "mode", "timestamp", *[js_round(F.col(c), 6).alias(c) for c in ("predicted_power", "lower_bound", "upper_bound")], "status")


@register("forecast_view", W(f"""
SELECT timestamp, value, count, coalesce(timestamp <= s.split, false) AS is_past,
       coalesce(timestamp >= s.split, true) AS is_future
FROM hm, (SELECT min(timestamp) AS split FROM hm WHERE timestamp >= TIMESTAMP '2024-01-15 12:00:00') s""",
          """hm AS (
  SELECT CAST(date_trunc('hour', processing_ts) AS TIMESTAMP) AS timestamp,
         """ + O.exact_avg("power_w") + """ AS value, count(*) AS count
  FROM readings WHERE power_w IS NOT NULL GROUP BY 1)"""), "forecast")
def q_forecast_view(spark, sf):
    return FC.forecast_view(S.hourly_mean(fx.readings(spark, sf)), VIEW_AS_OF)


register("tune_forecast", None, "forecast")(lambda spark, sf: FC.tune_forecast(S.hourly_mean(fx.readings(spark, sf))))

_COMBOS = FC._grid_rows(FC.FORECAST_GRID)
_GIVEN_MAE = ", ".join(
    f"({i}, {c['changepoint_prior_scale']!r}e0, {c['seasonality_prior_scale']!r}e0, '{c['seasonality_mode']}')"
    for i, c in enumerate(_COMBOS))


@register("best_params", W(f"""
SELECT w.combo, w.changepoint_prior_scale, w.seasonality_prior_scale, w.seasonality_mode, w.mae FROM (
  SELECT min_by(struct_pack(combo := combo, changepoint_prior_scale := cps, seasonality_prior_scale := sps,
                            seasonality_mode := mode, mae := mae), (mae, combo)) AS w
  FROM (SELECT g.*, abs(a.mean_power - 50.0e0 * g.combo) AS mae
        FROM (VALUES {_GIVEN_MAE}) g(combo, cps, sps, mode),
             (SELECT {O.exact_avg('power_w')} AS mean_power FROM readings) a) t) x"""), "forecast")
def q_best_params(spark, sf):
    """P4 winner choice on given MAE values (|mean power - 50 * combo index|)."""
    mean = fx.readings(spark, sf).agg(exact_avg("power_w")).scalar()
    combos = spark.createDataFrame(
        [(i, float(c["changepoint_prior_scale"]), float(c["seasonality_prior_scale"]), c["seasonality_mode"])
         for i, c in enumerate(_COMBOS)],
        "combo int, changepoint_prior_scale double, seasonality_prior_scale double, seasonality_mode string")
    hist = combos.withColumn("mae", F.abs(mean - F.lit(50.0) * F.col("combo")))
    return FC.best_params(hist)


#: A grid that the oracle can walk tree by tree; the whole grid is checked by tests.
SMALL_GRID = {"n_estimators": [10, 25], "contamination": [0.005, 0.01, 0.02], "max_features": [0.5, 1.0]}


def _tuning(spark, sf, grid=None):
    return M.tune_isolation_forest(_train_features(_stored_readings(spark, sf)), grid)


register("tune_isolation_forest", None, "anomaly")(lambda spark, sf: _tuning(spark, sf))

register("tune_isolation_forest_small", W(f"""
SELECT n_estimators, contamination, max_features, {_r6('score')} AS score
FROM (SELECT n_estimators, mf AS max_features, unnest([0.005e0, 0.01e0, 0.02e0]) AS contamination, avg(raw) - unnest(quantile_cont(raw, [0.005, 0.01, 0.02])) AS score
      FROM raws GROUP BY n_estimators, mf) x""",
    _grow_sql(25, [0.5, 1.0]) + ",\n" + _paths_sql() + f""",
raws AS (SELECT mf, k, 10 AS n_estimators, {_raw_sql(10)} AS raw FROM paths GROUP BY ALL UNION ALL SELECT mf, k, 25, {_raw_sql(25)} FROM paths GROUP BY ALL)"""), "anomaly")(
    lambda spark, sf: _tuning(spark, sf, SMALL_GRID).select("n_estimators", "contamination", "max_features", js_round(F.col("score"), 6).alias("score")))

register("grouped_percentiles", W("""
SELECT device_id, unnest([0.0e0, 0.05e0, 0.5e0, 0.95e0, 1.0e0]) AS q, unnest(list_transform(quantile_cont(power_w, [0.0, 0.05, 0.5, 0.95, 1.0]), lambda v: floor(v * 1e6 + 0.5e0) / 1e6)) AS value FROM readings
WHERE power_w IS NOT NULL GROUP BY device_id"""), "anomaly")(
    lambda spark, sf: exact_percentiles(fx.readings(spark, sf), "power_w", [0.0, 0.05, 0.5, 0.95, 1.0], ["device_id"]).withColumn("value", js_round(F.col("value"), 6)))


FLEET_TRAIN_HOURS = 31 * 24


@register("detect_anomalies_by_device", None, "anomaly")
def q_detect_by_device(spark, sf):
    """Fleet mode: anomalous hours of every device, one forest per device."""
    hm = S.hourly_mean(fx.readings(spark, sf), by_device=True)
    # every device's whole hourly history trains its forest (test devices have ~66 hours with data)
    return M.detect_anomalies_by_device(hm, AS_OF, train_hours=FLEET_TRAIN_HOURS, sensitivity=SENSITIVITY)
