"""Model invariants: planted spike is found; scores in range; deterministic forest."""

import datetime as dt
import math

from pyspark.sql import functions as F

from gridlens.operators import anomaly as M


def _series(spark, spike_at=None):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(7 * 24 * 6):
        ts = base + dt.timedelta(minutes=10 * i)
        v = 300 + 200 * math.sin(2 * math.pi * ts.hour / 24) + (i * 37 % 11)
        if spike_at is not None and i == spike_at:
            v = 6000.0
        rows.append((ts, float(v), i))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, value double, reading_id long")


def test_planted_spike_found(spark):
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    forest = M.fit_isolation_forest(train, n_estimators=50)
    test = _series(spark, spike_at=500)
    anoms = M.detect_anomalies(test, forest, sensitivity=0.8).collect()
    assert any(a.actual_power == 6000.0 and a.anomaly_type == "spike" for a in anoms)
    assert all(0.0 <= a.anomaly_score <= 1.0 for a in anoms)


def test_forest_is_deterministic_and_bounded(spark):
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    a = M.fit_isolation_forest(train, n_estimators=10, seed=7).orderBy("tree", "node").collect()
    b = M.fit_isolation_forest(train, n_estimators=10, seed=7).orderBy("tree", "node").collect()
    assert a == b
    assert max(r.depth for r in a) <= 8
    sizes = {}
    for r in a:
        sizes[r.tree] = sizes.get(r.tree, 0) + r.leaf_size
    assert set(sizes.values()) == {256}


def test_contamination_is_the_share_of_training_rows_below_the_offset(spark):
    from gridlens.operators import forest as FO
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    for share in (0.01, 0.05, 0.5):
        forest = M.fit_isolation_forest(train, n_estimators=20, contamination=share)
        scored = M.score_isolation_forest(train, forest)
        got = scored.agg(F.avg(F.col("is_outlier").cast("double")).alias("m"), F.count("*").alias("n")).first()
        assert got.n == 1008 and abs(got.m - share) <= 1.5 / 1008
    assert M.fit_isolation_forest(train, n_estimators=5).agg(F.min("tree")).first()[0] == 0
    auto = M.score_isolation_forest(train, M.fit_isolation_forest(train, n_estimators=5)).filter((F.col("raw_score") - FO.AUTO_OFFSET) != F.col("decision"))
    assert auto.count() == 0
    import pytest
    with pytest.raises(ValueError):
        M.fit_isolation_forest(train, contamination=0.7)


def test_detection_of_a_given_forest_starts_no_job_when_built(spark):
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    forest = M.fit_isolation_forest(train, n_estimators=5, contamination=0.01)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    M.detect_anomalies(_series(spark, 500), forest)
    M.score_isolation_forest(train, forest)
    assert list(tracker.getJobIdsForGroup("build")) == []
    spark.sparkContext.setJobGroup("other", "other")


def test_scores_follow_the_paths_of_the_node_table(spark):
    """Arrow scoring against walking the nodes row by row; missing children are empty leaves."""
    import numpy as np
    from gridlens.operators import forest as FO
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    forest = M.fit_isolation_forest(train, n_estimators=7, seed=3)
    nodes = {(r.tree, r.node): r for r in forest.collect()}
    rows = FO.with_raw_score(train.repartition(3), forest).collect()
    c = lambda n: float(FO.average_path_length([n])[0])
    for r in rows[::17]:
        x, paths = [r[f] for f in FO.FEATURES], []
        for t in range(7):
            n = 0
            while (t, n) in nodes and nodes[t, n].feature >= 0:
                n = 2 * n + (1 if x[nodes[t, n].feature] < nodes[t, n].threshold else 2)
            paths.append(math.floor(math.log2(n + 1)) + (c(nodes[t, n].leaf_size) if (t, n) in nodes else 0.0))
        assert math.isclose(r.raw_score, -2 ** (-np.mean(paths) / c(256)), rel_tol=1e-12)
    few = M.fit_isolation_forest(train.limit(47), n_estimators=5, contamination=0.01)
    assert few.count() == 0 and M.score_isolation_forest(train, few).filter("raw_score <> 0 or is_outlier is null").count() == 0


def test_grouped_percentiles(spark):
    import random
    import numpy as np
    from gridlens.functions.quantiles import exact_percentiles
    rng = random.Random(4)
    values = {"one": [3.5], "ties": [1.0] * 40 + [2.0] * 3, "many": [rng.gauss(0, 1) ** 3 for _ in range(3000)], "two": [-1.0, 5.0]}
    df = spark.createDataFrame([(k, 1, v) for k, vs in values.items() for v in vs] + [("many", 1, None), ("none", 1, None)], "k string, g int, x double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.904, 1.0]
    got = {(r.k, r.q): r.value for r in exact_percentiles(df, "x", qs, ["k", "g"]).collect()}
    assert set(got) == {(k, q) for k in values for q in qs}
    for (k, q), v in got.items():
        assert math.isclose(v, np.quantile(values[k], q), rel_tol=1e-12, abs_tol=1e-12)


def test_tuning_scores_equal_separate_forests(spark):
    import numpy as np
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    grid = {"n_estimators": [4, 9], "contamination": [0.01, 0.1], "max_features": [0.5, 1.0]}
    got = {(r.n_estimators, r.contamination, r.max_features): r for r in M.tune_isolation_forest(train, grid).collect()}
    assert len(got) == 8 and sum(r.is_best for r in got.values()) == 1
    for n in grid["n_estimators"]:
        for mf in grid["max_features"]:
            forest = M.fit_isolation_forest(train, n, max_features=mf)
            raw = [r.raw_score for r in M.with_raw_score(train, forest).collect()]
            for c in grid["contamination"]:
                assert math.isclose(got[n, c, mf].score, np.mean(raw) - np.quantile(raw, c), rel_tol=1e-9)
    best = max(got.values(), key=lambda r: r.score)
    assert best.is_best


def test_fleet_names_short_devices(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(d, base + dt.timedelta(hours=i), 100.0 + i % 24) for d, n in (("long", 100), ("short", 47)) for i in range(n)]
    rows += [("old", base - dt.timedelta(days=60), 1.0), ("none", None, None)]
    hourly = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, value double")
    out = M.detect_anomalies_by_device(hourly, base + dt.timedelta(hours=100), n_estimators=10).collect()
    assert sorted(r.device_id for r in out if r.status == "short") == ["none", "old", "short"]
    assert all(r.timestamp is None and r.anomaly_type is None for r in out if r.status == "short")


def _hourly(spark, days=10, noise=True):
    import numpy as np
    rng = np.random.default_rng(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(days * 24):
        ts = base + dt.timedelta(hours=i)
        v = 500 + 300 * math.sin(2 * math.pi * ts.hour / 24)
        if noise:
            v += float(rng.normal(0, 40))
        rows.append((ts, float(v)))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, value double")


def test_forecast_invariants_and_skill(spark):
    from gridlens.operators import forecast as FC
    full = _hourly(spark, 10)
    train = full.filter(F.col("timestamp") < dt.datetime(2024, 1, 9))
    model = FC.fit_forecast(train).persist()
    fc = FC.forecast(model, "2024-01-09 00:00:00", 24, 6).collect()
    assert len(fc) == len({r.timestamp for r in fc}) == 24 + 6 + 1
    assert all(r.lower_bound <= r.predicted_power for r in fc)
    assert all(r.predicted_power >= 0 and r.lower_bound >= 0 for r in fc)
    actual = {r.timestamp: r.value for r in full.collect()}
    fut = [r for r in fc if r.timestamp >= dt.datetime(2024, 1, 9)]
    mae = sum(abs(r.predicted_power - actual[r.timestamp]) for r in fut if r.timestamp in actual) / 24
    naive = sum(abs(actual[r.timestamp - dt.timedelta(days=1)] - actual[r.timestamp])
                for r in fut if r.timestamp in actual) / 24
    assert mae < naive
    again = FC.forecast(FC.fit_forecast(train), "2024-01-09 00:00:00", 24, 6).collect()
    assert sorted(fc) == sorted(again)


def test_forecast_request_limits():
    from gridlens.operators import forecast as FC
    assert FC.clip_request(24, 100) == (24, 8)
    assert FC.clip_request(48, 40) == (48, 16)
    import pytest
    with pytest.raises(ValueError):
        FC.clip_request(49)


def test_fleet_detection_finds_planted_spike_per_device(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for dev in ("a", "b", "c"):
        for i in range(7 * 24):
            ts = base + dt.timedelta(hours=i)
            v = 400 + 150 * math.sin(2 * math.pi * ts.hour / 24) + float(rng.normal(0, 15))
            if dev == "b" and i == 7 * 24 - 5:
                v = 5000.0
            rows.append((dev, ts, float(v)))
    hourly = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, value double")
    out = M.detect_anomalies_by_device(hourly, base + dt.timedelta(hours=7 * 24), n_estimators=50).collect()
    assert any(r.device_id == "b" and r.actual_power == 5000.0 and r.anomaly_type == "spike" for r in out)
    assert all(r.device_id == "b" for r in out if r.actual_power >= 5000.0)


def test_planted_spike_found_with_default_contamination(spark):
    train = M.anomaly_features(_series(spark)).withColumnRenamed("reading_id", "row_key")
    forest = M.fit_isolation_forest(train, n_estimators=50, contamination=0.01)
    assert forest.filter("tree = -1").count() == 1
    anoms = M.detect_anomalies(_series(spark, spike_at=500), forest, sensitivity=0.8).collect()
    assert any(a.actual_power == 6000.0 and a.anomaly_type == "spike" for a in anoms)


def test_tuned_parameters_are_merged_saved_and_read(spark):
    from gridlens.operators import forecast as FC
    hist = spark.createDataFrame([(0, 0.1, 10.0, 5.0), (1, 0.5, 0.1, 4.0), (2, 0.01, 1.0, 4.0)],
                                 "combo int, changepoint_prior_scale double, seasonality_prior_scale double, mae double")
    best = FC.best_params(hist).first()
    assert (best.combo, best.changepoint_prior_scale, best.seasonality_mode) == (1, 0.5, "additive")
    record = FC.tuning_record(hist, "2024-01-31 00:00:00")
    row = record.first()
    assert (row.best_mae, row.n_combos, str(row.tuned_at)) == (4.0, 3, "2024-01-31 00:00:00")
    assert FC.saved_params(record) == {"changepoint_prior_scale": 0.5, "seasonality_prior_scale": 0.1, "seasonality_mode": "additive"}
    assert FC.saved_params(record.limit(0)) == FC.saved_params(None) == FC.DEFAULT_PARAMS


def test_short_series_have_a_status_row(spark):
    from gridlens.operators import forecast as FC
    base = dt.datetime(2024, 1, 1)
    rows = [(d, base + dt.timedelta(hours=i), 100.0 + i % 24) for d, n in (("long", 48), ("short", 47)) for i in range(n)]
    series = spark.createDataFrame([*rows, ("none", None, None)], "device_id string, timestamp timestamp_ntz, value double")
    model = FC.fit_forecast(series, keys=("device_id",)).persist()
    assert {r.device_id: (r.status, r.n_points, r.k is None) for r in model.collect()} == {
        "long": ("ok", 48, False), "short": ("short", 47, True), "none": ("short", 0, True)}
    out = FC.forecast(model, "2024-01-03 00:00:00", 24, keys=("device_id",)).collect()
    assert sum(r.device_id == "long" and r.predicted_power is not None for r in out) == 25
    short = [r for r in out if r.status == "short"]
    assert sorted(r.device_id for r in short) == ["none", "short"]
    assert all((r.timestamp, r.predicted_power, r.lower_bound, r.upper_bound) == (None,) * 4 for r in short)


def test_every_device_has_a_model_or_a_status(spark):
    from conftest import SMALL
    from gridlens.plans.catalog import queries
    from gridlens.sources import fixtures as fx
    devices = fx.readings(spark, SMALL).select("device_id").distinct().count()
    models = queries()["fit_forecast_by_device"](spark, SMALL).collect()
    assert len(models) == len({r.device_id for r in models}) == devices
    # on this table a device reaches 48 hours or has no power reading at all
    assert {(r.status, r.n_points >= 48, r.n_points == 0) for r in models} <= {("ok", True, False), ("short", False, True)}
    fitted = {r.device_id for r in models if r.status == "ok"}
    out = queries()["forecast_by_device"](spark, SMALL).collect()
    assert fitted and len({r.device_id for r in out}) == devices
    assert {r.device_id for r in out if r.predicted_power is not None} == fitted


def _noisy(days=12, seed=5):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2024-01-01 05:00", periods=days * 24, freq="h")
    keep = rng.random(len(ts)) < 0.93  # hours without data
    v = 400 + 0.4 * np.arange(len(ts)) + 150 * np.sin(2 * np.pi * ts.hour / 24) + 60 * (ts.dayofweek >= 5) + rng.normal(0, 25, len(ts))
    return pd.DataFrame({"timestamp": ts[keep], "value": np.asarray(v)[keep]})


def test_fits_from_sums_equal_fits_of_rows(spark):
    import numpy as np
    from forecast_rows import fit_rows
    from gridlens.operators import forecast as FC
    frames = {d: _noisy(days, seed) for d, days, seed in (("a", 12, 5), ("b", 40, 6), ("c", 3, 7))}
    rows = [(d, t.to_pydatetime(), float(v)) for d, f in frames.items() for t, v in f.itertuples(index=False)]
    series = spark.createDataFrame(rows, "device_id string, timestamp timestamp_ntz, value double").repartition(5)
    for mode in ("additive", "multiplicative"):
        params = {"changepoint_prior_scale": 0.1, "seasonality_prior_scale": 1.0, "seasonality_mode": mode}
        for r in FC.fit_forecast(series, params, keys=("device_id",)).collect():
            want = fit_rows(frames[r.device_id]["timestamp"], frames[r.device_id]["value"], params)
            for c in ("t0", "t_span", "y_scale", "k", "m", "changepoints", "deltas", "beta_sin", "beta_cos", "sigma"):
                assert np.allclose(r[c], want[c], rtol=1e-5, atol=1e-7), (mode, r.device_id, c)
            assert r.n_points == len(r.history_ts) == len(frames[r.device_id]) and (r.mode, r.status) == (mode, "ok")


def test_cross_validation_from_sums_equals_fits_of_rows(spark):
    import numpy as np
    from forecast_rows import fit_rows, predict_rows
    from gridlens.operators import forecast as FC
    from gridlens.operators import series as S
    frame = _noisy(9)
    df = spark.createDataFrame([(t.to_pydatetime(), float(v)) for t, v in frame.itertuples(index=False)], "timestamp timestamp_ntz, value double")
    splits = S.expanding_splits(df).toPandas()
    got = {r.combo: r for r in FC.tune_forecast(df).collect()}
    combos = FC._grid_rows(FC.FORECAST_GRID)
    assert len(got) == len(combos) == 32
    for i, combo in enumerate(combos):
        maes = []
        for _, part in splits.groupby("fold"):
            train, held = part[part.role == "train"], part[part.role == "validation"]
            maes.append(np.mean(np.abs(held["value"] - predict_rows(fit_rows(train["timestamp"], train["value"], combo), held["timestamp"]))))
        assert math.isclose(got[i].mae, np.mean(maes), rel_tol=1e-5) and got[i].folds == len(maes) == 4
    assert [i for i, r in got.items() if r.is_best] == [min(got, key=lambda i: (got[i].mae, i))]


def test_tuning_does_not_shuffle_by_the_grid(spark):
    """Sums are grouped once; only models and validation rows know of combinations."""
    from gridlens.operators import forecast as FC
    df = _hourly(spark, 9)
    plans = [FC.tune_forecast(df, {k: v[:n] for k, v in FC.FORECAST_GRID.items()})._jdf.queryExecution().executedPlan().toString() for n in (1, 4)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "FlatMapGroupsInPandas" not in plans[1]
