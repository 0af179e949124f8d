"""Anomaly detection with isolation forests (M1, M4-M7, P5); the forests themselves are in ``forest``.

A row's features are windows of its own series.  Rows are scored once, and the
scored rows, a few columns wide, are exchanged once; offsets, bounds, thresholds
and the classification all read that exchange.  Global figures are scalar
subqueries, so building a query starts no job.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_percentile, exact_percentiles
from ..functions.rounding import exact_avg, exact_sum
from ..session import saved, spread_for_python
from . import forest  # noqa: F401
from .forest import (AUTO_OFFSET, FEATURES, MIN_TRAINING_ROWS, fit_isolation_forest, fit_score_np, forest_offset, grow, raw_scores,  # noqa: F401
                     score_rows, sub_samples, with_raw_score)
from .series import EXPECTED_WINDOW, ROLLING_ROWS, cyclic_time_features, expected_value, over_blocks, rolling_features

# Fixed values of the detector.
DEFAULT_CONTAMINATION = 0.01   # default forest parameters: offset = 1st percentile of training scores
MIN_THRESHOLD = 0.7
MIN_POWER_DIFF_W = 150.0
SPIKE_FACTOR, DIP_FACTOR = 1.5, 0.5
SEVERITY_HIGH_COUNT, SEVERITY_MEDIUM_COUNT = 20, 10
SEVERITY_HIGH_SCORE, SEVERITY_MEDIUM_SCORE = 0.8, 0.6
BAND_HIGH, BAND_MEDIUM = 0.9, 0.7
OK, SHORT = "ok", "short"


# ---------------------------------------------------------------- M1
def anomaly_features(df: DataFrame, ts: str = "timestamp", value: str = "value", order_cols=None,
                     partition_cols=(), block_rows: int | None = None, expected: bool = False) -> DataFrame:
    """M1: the 8 features (raw value, cyclic hour/weekday, 5-row rolling stats).

    With ``expected`` also W4's expected value, from the same pass over the blocks.
    """
    order_cols = order_cols or (ts,)

    def windows(d, partition, order):
        d = rolling_features(d, value, order, partition)
        return expected_value(d, value, order, partition) if expected else d

    if block_rows:
        before, after = (EXPECTED_WINDOW // 2, EXPECTED_WINDOW - EXPECTED_WINDOW // 2 - 1) if expected else (ROLLING_ROWS - 1, 0)
        d = over_blocks(df, windows, order_cols, partition_cols, before, after, block_rows)
    else:
        d = windows(df, partition_cols, order_cols)
    d = cyclic_time_features(d, ts)
    return d.withColumnRenamed(value, "value") if value != "value" else d


# ---------------------------------------------------------------- M3
def score_isolation_forest(df: DataFrame, forest: DataFrame, offset: F.Column | float | None = None) -> DataFrame:
    """M3: ``raw_score`` (score_samples), ``decision``, ``is_outlier`` and ``anomaly_score`` in [0, 1].

    ``offset`` is the forest's own where not given.  ``anomaly_score = 1 - (d - min d) /
    (max d - min d)`` over the scored frame (0 when all decisions are equal).
    """
    off = forest_offset(forest) if offset is None else offset if isinstance(offset, F.Column) else F.lit(float(offset))
    # one exchange behind the scorer: bounds, thresholds and results read the same scored rows
    s = with_raw_score(df, forest).repartition("raw_score")
    s = s.withColumn("decision", F.col("raw_score") - off).withColumn("is_outlier", F.col("decision") < 0)
    bounds = s.agg(F.struct(F.min("decision").alias("lo"), F.max("decision").alias("hi"))).scalar()
    dmin, dmax = bounds.getField("lo"), bounds.getField("hi")
    return s.withColumn("anomaly_score", F.when(dmax == dmin, F.lit(0.0))
                        .otherwise(F.lit(1.0) - (F.col("decision") - dmin) / (dmax - dmin)))


# ---------------------------------------------------------------- M4 / M5
def anomaly_threshold(scores: DataFrame, sensitivity: float = 0.8, score: str = "anomaly_score") -> DataFrame:
    """M4: ``max(0.7, percentile(score, 100 - 15 * s^2))`` with linear interpolation (one row)."""
    pct = (100.0 - (sensitivity ** 2) * 15.0) / 100.0
    return exact_percentile(scores, score, pct).select(F.greatest(F.lit(MIN_THRESHOLD), F.col("value")).alias("threshold"))


def classify_anomalies(df: DataFrame, threshold: F.Column, actual: str = "value", expected: str = "expected",
                       score: str = "anomaly_score", flag: str = "is_outlier") -> DataFrame:
    """M5 rule: flagged, score above threshold and |actual - expected| >= 150 W; spike / dip / pattern_change."""
    a, e = F.col(actual), F.col(expected)
    keep = F.col(flag) & (F.col(score) > threshold) & (F.abs(a - e) >= MIN_POWER_DIFF_W)
    kind = F.when(a > e * SPIKE_FACTOR, "spike").when(a < e * DIP_FACTOR, "dip").otherwise("pattern_change")
    return df.filter(keep).select(
        "timestamp", a.alias("actual_power"), e.alias("expected_power"),
        F.col(score).alias("anomaly_score"), kind.alias("anomaly_type"))


def detect_anomalies(df: DataFrame, forest: DataFrame, sensitivity: float = 0.8,
                     offset: F.Column | float | None = None, order_cols=("timestamp",),
                     partition_cols=(), block_rows: int | None = None) -> DataFrame:
    """M5: features -> score -> threshold -> classification of a recent frame.

    The decision offset is ``offset`` when given, else the forest's own (fitted
    with a contamination share), else -0.5.
    """
    feats = anomaly_features(df, order_cols=order_cols, partition_cols=partition_cols, block_rows=block_rows, expected=True)
    scored = score_isolation_forest(feats, forest, offset)
    return classify_anomalies(scored, anomaly_threshold(scored, sensitivity).scalar())


# ---------------------------------------------------------------- M6 / M7
def anomaly_summary(anoms: DataFrame) -> DataFrame:
    """M6: count and severity (high: >20 or mean score >0.8; medium: >10 or >0.6; else low)."""
    g = anoms.agg(F.count(F.lit(1)).alias("total_count"), exact_avg("anomaly_score").alias("avg_score"))
    c, m = F.col("total_count"), F.col("avg_score")
    sev = (F.when(c == 0, "low")
           .when((c > SEVERITY_HIGH_COUNT) | (m > SEVERITY_HIGH_SCORE), "high")
           .when((c > SEVERITY_MEDIUM_COUNT) | (m > SEVERITY_MEDIUM_SCORE), "medium").otherwise("low"))
    return g.select("total_count", sev.alias("severity"))


def _to_fixed(x: F.Column, digits: int) -> F.Column:
    """JS ``toFixed`` as a number: half away from zero."""
    s = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * s + 0.5) / s


def anomaly_view(anoms: DataFrame) -> DataFrame:
    """M7: display rows, highest score first: deviation %, score %, confidence band."""
    a, e, s = F.col("actual_power"), F.col("expected_power"), F.col("anomaly_score")
    return anoms.select(
        "timestamp", "actual_power", "expected_power", "anomaly_score", "anomaly_type",
        _to_fixed((a - e) / e * 100.0, 1).alias("deviation_pct"),
        _to_fixed(s * 100.0, 0).alias("score_pct"),
        F.when(s > BAND_HIGH, "high").when(s > BAND_MEDIUM, "medium").otherwise("low").alias("band"),
    ).orderBy(F.col("anomaly_score").desc(), "timestamp")


def anomaly_type_counts(anoms: DataFrame) -> DataFrame:
    t = F.col("anomaly_type")
    return anoms.agg(F.count_if(t == "spike").alias("spikes"), F.count_if(t == "dip").alias("dips"),
                     F.count_if(t == "pattern_change").alias("patterns"))


# ---------------------------------------------------------------- P5 (forest tuning)
def grid_scores(features: DataFrame, n_estimators: list, max_features: list, seed: int = 42, key: str = "row_key") -> DataFrame:
    """(max_features, n_estimators, raw_score): every row's score by every forest of the grid.

    Trees are grown once per ``max_features`` value for the largest
    ``n_estimators``; a smaller forest is the first n trees (tree t draws the same
    sub-sample in every one), so one pass of a row through the largest gives all scores.
    """
    features = saved(features.select(key, *FEATURES), "training")  # counted, sampled and scored
    mfs, sizes = sorted({float(m) for m in max_features}), sorted({int(n) for n in n_estimators})
    samples = sub_samples(features, sizes[-1], seed, key).withColumn("mf", F.explode(F.array(*map(F.lit, mfs))))
    nodes = saved(grow(samples, seed=seed, by="mf"), "forests")
    kind = T.StructType([T.StructField("s", T.ArrayType(T.StructType([
        T.StructField("max_features", T.DoubleType()), T.StructField("n_estimators", T.IntegerType()), T.StructField("raw_score", T.DoubleType())])))])

    def scores(model, x):
        groups = sorted(model)
        each = np.stack([raw_scores(paths[:, :n]) for paths in (model[g].paths(x) for g in groups) for n in sizes], axis=1) if groups else np.zeros((len(x), 0))
        pairs = [(g[0], n) for g in groups for n in sizes]
        flat = pa.StructArray.from_arrays([pa.array(np.tile([p[0] for p in pairs], len(x)), pa.float64()), pa.array(np.tile([p[1] for p in pairs], len(x)), pa.int32()),
                                           pa.array(each.ravel())], ["max_features", "n_estimators", "raw_score"])
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pairs), pa.int32()), flat)]

    return score_rows(features.select(*FEATURES), nodes, kind, scores, ("mf",)).select(F.explode("s").alias("s")).select("s.*")


def mean_decisions(scores: DataFrame, contamination: list) -> DataFrame:
    """(n_estimators, contamination, max_features, score, is_best): mean score less its contamination quantile, per forest; highest wins.

    ``scores`` has (max_features, n_estimators, raw_score) rows.
    """
    keys = ["max_features", "n_estimators"]
    shared = scores.repartition(*keys, F.pmod(F.xxhash64("raw_score"), F.lit(64)))  # scored once: quantiles look several times
    means = shared.groupBy(*keys).agg((exact_sum("raw_score") / F.count("raw_score").cast("double")).alias("mean_raw"))
    offsets = exact_percentiles(shared, "raw_score", sorted({float(c) for c in contamination}), keys)
    res = offsets.join(means, keys).select("n_estimators", F.col("q").alias("contamination"), "max_features", (F.col("mean_raw") - F.col("value")).alias("score"))
    order = F.struct("score", -F.col("n_estimators"), -F.col("contamination"), -F.col("max_features"))
    best = res.agg(F.max_by(F.struct("n_estimators", "contamination", "max_features"), order)).scalar()
    own = F.struct("n_estimators", "contamination", "max_features")
    return res.withColumn("is_best", F.coalesce(own == best, F.lit(False)))


def tune_isolation_forest(features: DataFrame, grid: dict | None = None, seed: int = 42,
                          key: str = "row_key") -> DataFrame:
    """P5: mean decision score of every (n_estimators, contamination, max_features); highest wins."""
    from .forecast import FOREST_GRID
    g = grid or FOREST_GRID
    return mean_decisions(grid_scores(features, g["n_estimators"], g["max_features"], seed, key), g["contamination"])


# ---------------------------------------------------------------- fleet mode (one forest per device)
def fit_score_by_key(train: DataFrame, keys=("device_id",), score_from=None, sensitivity: float = 0.8,
                     n_estimators: int = 100, max_features: float = 1.0, seed: int = 42,
                     ts: str = "timestamp", contamination=DEFAULT_CONTAMINATION) -> DataFrame:
    """M2+M3 per key in one grouped pass: fit on the key's rows, score those at/after ``score_from``.

    The forest never leaves the Python worker (no node table shuffle); a group
    is one device's hourly rows of the training window.  ``status`` is ``ok``,
    or ``short`` in the one row of a key of under 48 rows.
    """
    keys = list(keys)
    cols = [c for c in train.columns]
    src = train.withColumn("_score", F.lit(True) if score_from is None else F.col(ts) >= score_from)
    out_fields = [f for f in train.schema.fields] + [
        T.StructField("raw_score", T.DoubleType()), T.StructField("decision", T.DoubleType()),
        T.StructField("is_outlier", T.BooleanType()), T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("status", T.StringType())]
    schema = T.StructType(out_fields)
    names = [f.name for f in schema.fields]
    pct = 100.0 - (sensitivity ** 2) * 15.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["value"].notna()]
        if len(known) < MIN_TRAINING_ROWS:
            row = {**dict.fromkeys(names), **{k: pdf[k].iloc[0] for k in keys}, "status": SHORT}
            return pd.DataFrame([row], columns=names)
        pdf = known.sort_values(ts, kind="mergesort")         # arrival order must not matter
        mask = pdf["_score"].to_numpy(dtype=bool)
        if not mask.any():
            return pd.DataFrame(columns=names)
        x = pdf[FEATURES].to_numpy(dtype=float)
        tag = zlib.crc32("|".join(str(pdf[k].iloc[0]) for k in keys).encode())
        raw_all = fit_score_np(x, n_estimators, max_features, seed + tag)
        off = (AUTO_OFFSET if contamination in (None, "auto")
               else float(np.percentile(raw_all, 100.0 * float(contamination))))
        rows = pdf[mask].copy()
        raw = raw_all[mask]
        d = raw - off
        lo, hi = d.min(), d.max()
        norm = np.zeros_like(d) if hi == lo else 1.0 - (d - lo) / (hi - lo)
        rows["raw_score"], rows["decision"], rows["is_outlier"], rows["anomaly_score"] = raw, d, d < 0, norm
        rows["threshold"], rows["status"] = max(MIN_THRESHOLD, float(np.percentile(norm, pct))), OK
        return rows[names]

    return spread_for_python(src.select(*cols, "_score"), *keys).groupBy(*keys).applyInPandas(run, schema=schema)


def detect_anomalies_by_device(hourly: DataFrame, as_of, train_hours: int = 168, detect_hours: int = 24,
                               sensitivity: float = 0.8, n_estimators: int = 100, seed: int = 42) -> DataFrame:
    """M5 for fleets: per-device hourly means, one forest per device, anomalous hours per device.

    ``hourly``: ``(device_id, timestamp, value)`` (A16 by device).  Features
    and the expected value are device-partitioned windows over hourly rows,
    so every window and every Python group is bounded by hours, not by the
    raw volume of a device.  Anomalies have ``status`` ``ok``; a device with under
    48 hours in the window has one row with ``status`` ``short`` and nothing else.
    """
    from .periods import _ts
    now = _ts(as_of)
    inside = (F.col("timestamp") >= now - F.make_dt_interval(hours=F.lit(train_hours))) & (F.col("timestamp") <= now)
    # one row without a value stands for each device, so that one without any hour in the window is named, too
    named = hourly.select("device_id").distinct().select("device_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("double").alias("value"))
    h = hourly.filter(inside & F.col("value").isNotNull()).select("device_id", "timestamp", "value")
    feats = anomaly_features(h, partition_cols=("device_id",), expected=True)
    rows = feats.select("device_id", "timestamp", "expected", *FEATURES).unionByName(named, allowMissingColumns=True)
    scored = fit_score_by_key(rows, ("device_id",), now - F.make_dt_interval(hours=F.lit(detect_hours)), sensitivity, n_estimators, seed=seed)
    return _classify_keyed(scored)


def _classify_keyed(scored: DataFrame) -> DataFrame:
    a, e = F.col("value"), F.col("expected")
    short = F.col("status") == SHORT
    keep = F.col("is_outlier") & (F.col("anomaly_score") > F.col("threshold")) & (F.abs(a - e) >= MIN_POWER_DIFF_W)
    kind = F.when(a > e * SPIKE_FACTOR, "spike").when(a < e * DIP_FACTOR, "dip").otherwise("pattern_change")
    return scored.filter(short | keep).select("device_id", "timestamp", a.alias("actual_power"), e.alias("expected_power"),
                                              "anomaly_score", F.when(~short, kind).alias("anomaly_type"), "status")
