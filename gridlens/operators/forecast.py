"""Hourly power forecasting.

Model: additive (or multiplicative) decomposition after Taylor & Letham
(2018), "Forecasting at scale" -- a piecewise-linear trend with changepoints
in the first 80 % of the history, plus daily (order 4) and weekly (order 3)
Fourier seasonality, fitted by MAP with Gaussian priors (ridge penalties
``sigma^2 / changepoint_prior_scale^2`` and ``sigma^2 /
seasonality_prior_scale^2``) on max-abs scaled values.  The band is
``+-1.2816 sigma`` of the residuals (80 %).

Spark layout: within a segment between two changepoints the trend's columns
are linear in time, and the seasonal columns depend on the second of the week
only.  So counts and sums of ``t, t^2, y, t*y, y^2`` by (segment, second of the
week) hold all of X'X and X'y.  They are a grouped aggregation (``moment_cells``,
exact, partial before the shuffle); of an hourly series at most 26 x 168 cells
reach Python, however long its history, and only the 41 x 41 system is solved
there.  The same sums give the residuals, so no pass over the rows follows.
The fitted model is a row of arrays, and prediction is pure column arithmetic on
an hourly grid built with ``sequence``/``explode``.

Tuning groups by the segments that a row has in all folds at once: folds only
grow, so each row is summed once and every fold adds up its cells.  The
parameter grid is solved on those sums, and validation rows meet the models
of their fold in a join.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import exact_avg
from ..session import spread_for_python
from .series import expanding_splits

# Fixed values of the model and of the tuning grids.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
DAILY_ORDER, WEEKLY_ORDER = 4, 3
INTERVAL_Z = 1.2815515655446004       # 80 % two-sided normal quantile
MIN_TRAINING_POINTS = 48
MAX_FORECAST_HOURS = 48
MAX_PAST_CONTEXT_HOURS = 16
DEFAULT_PARAMS = {"changepoint_prior_scale": 0.05, "seasonality_prior_scale": 1.0, "seasonality_mode": "additive"}
FORECAST_GRID = {
    "changepoint_prior_scale": [0.001, 0.01, 0.1, 0.5],
    "seasonality_prior_scale": [0.01, 0.1, 1.0, 10.0],
    "seasonality_mode": ["additive", "multiplicative"],
}
FOREST_GRID = {
    "n_estimators": [50, 100, 200],
    "contamination": [0.005, 0.01, 0.02],
    "max_features": [0.5, 0.75, 1.0],
}

MODEL_SCHEMA = T.StructType([
    T.StructField("t0", T.DoubleType()), T.StructField("t_span", T.DoubleType()),
    T.StructField("y_scale", T.DoubleType()), T.StructField("mode", T.StringType()),
    T.StructField("k", T.DoubleType()), T.StructField("m", T.DoubleType()),
    T.StructField("changepoints", T.ArrayType(T.DoubleType())), T.StructField("deltas", T.ArrayType(T.DoubleType())),
    T.StructField("periods", T.ArrayType(T.DoubleType())), T.StructField("orders", T.ArrayType(T.IntegerType())),
    T.StructField("beta_sin", T.ArrayType(T.DoubleType())), T.StructField("beta_cos", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()), T.StructField("n_points", T.LongType()),
    T.StructField("train_start", T.TimestampNTZType()), T.StructField("train_end", T.TimestampNTZType()),
    # training timestamps (bounded by the training window): the history part of the prediction grid
    T.StructField("history_ts", T.ArrayType(T.TimestampNTZType())),
    T.StructField("status", T.StringType()),  # OK, or SHORT for a series of too few points, which has no parameters
])
OK, SHORT = "ok", "short"
_SEASONS = [(1.0, DAILY_ORDER), (7.0, WEEKLY_ORDER)]     # (period in days, Fourier order)


# ---------------------------------------------------------------- sums
WEEK = 7 * 86400
_DEC = "decimal(38,10)"
CELL = "n bigint, u double, uu double, y double, uy double, yy double, y_max double, u_max bigint"


def changepoint_places(n: F.Column) -> F.Column:
    """Places (from 0, in time order) of the changepoints of a history of ``n`` points: evenly over its first 80 %."""
    some = F.least(F.lit(N_CHANGEPOINTS), F.greatest(n - 2, F.lit(0))).cast("int")
    last = F.greatest(F.floor(n * F.lit(CHANGEPOINT_RANGE)) - 1, F.lit(0)).cast("double")
    return F.when(some > 0, F.transform(F.sequence(F.lit(1), some), lambda i: F.rint(i * (last / some)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def segment_of(place: F.Column, places: F.Column) -> F.Column:
    """How many changepoints come before the point at ``place``."""
    return F.size(F.filter(places, lambda c: c < place))


def ordered_points(series: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """(keys, ts, y, place, n, t0, u): points with a value, in time order; ``u`` is whole seconds since ``t0``."""
    whole = Window.partitionBy(*keys)
    pts = series.filter(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("y"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return (pts.withColumn("place", F.row_number().over(whole.orderBy("ts", "y")).cast("bigint") - 1)
            .withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("t0", F.min("ts").over(whole))
            .withColumn("u", seconds("ts") - seconds("t0")).withColumn("second", F.pmod(seconds("ts"), F.lit(WEEK))))


def cell_sums() -> list:
    """The aggregates of a cell, exact in any order of rows."""
    y, u = F.col("y"), F.col("u")
    exact = lambda c, name: F.sum(c.cast(_DEC)).cast("double").alias(name)
    return [F.count(F.lit(1)).alias("n"), F.sum("u").cast("double").alias("u"), F.sum((u * u).cast("decimal(38,0)")).cast("double").alias("uu"),
            exact(y, "y"), exact(y * u, "uy"), exact(y * y, "yy"), F.max(F.abs("y")).alias("y_max"), F.max("u").alias("u_max")]


def moment_cells(series: DataFrame, keys=(), ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(keys, segment, second of the week, sums): all of a fit's X'X and X'y, by cells in which its columns are linear."""
    pts = ordered_points(series, keys, ts, value).withColumn("segment", segment_of(F.col("place"), changepoint_places(F.col("n"))))
    return pts.groupBy(*keys, "segment", "second").agg(*cell_sums())


# ---------------------------------------------------------------- solving (a few sums of one series)
def _fourier(days: np.ndarray):
    cols, periods, orders = [], [], []
    for period, order in _SEASONS:
        for n in range(1, order + 1):
            w = 2.0 * math.pi * n * days / period
            cols.append(np.sin(w))
            cols.append(np.cos(w))
            periods.append(period)
            orders.append(n)
    return np.column_stack(cols), periods, orders


def _ridge(gram: np.ndarray, target: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + np.diag(penalty + 1e-9), target)


class Moments:
    """X'X, X'y and residual sums of one series, from its cells; values scaled to 1 and times to [0, 1].

    In a cell the trend's columns are ``A + B t``, so products of two of them, or of one and a value, are sums of cells.
    """

    def __init__(self, cells: dict, segment: np.ndarray, changepoints: np.ndarray, span: float, y_scale: float):
        self.changepoints = cps = np.asarray(changepoints, float) / span
        self.n, self.t, self.tt = np.asarray(cells["n"], float), np.asarray(cells["u"], float) / span, np.asarray(cells["uu"], float) / span ** 2
        self.y, self.ty, self.yy = np.asarray(cells["y"], float) / y_scale, np.asarray(cells["uy"], float) / (span * y_scale), np.asarray(cells["yy"], float) / y_scale ** 2
        on = np.arange(len(cps))[None, :] < np.asarray(segment)[:, None]
        zero, one = np.zeros((len(on), 1)), np.ones((len(on), 1))
        self.a = np.hstack([zero, one, np.where(on, -cps[None, :], 0.0)])
        self.b = np.hstack([one, zero, on.astype(float)])
        # Fourier columns by the second of the (epoch's) week
        self.f, self.periods, self.orders = _fourier(np.asarray(cells["second"], float) / 86400.0)
        self.points, self.sum_y, self.sum_yy = self.n.sum(), self.y.sum(), self.yy.sum()
        self.gram_t = self._quadratic(self.n, self.t, self.tt)
        self.target_t = self.a.T @ self.y + self.b.T @ self.ty
        self.gram_f = self.f.T @ (self.f * self.n[:, None])
        self.cross = (self.a * self.n[:, None] + self.b * self.t[:, None]).T @ self.f
        self.target_f = self.f.T @ self.y

    def _quadratic(self, n, t, tt) -> np.ndarray:
        mixed = self.a.T @ (self.b * t[:, None])
        return self.a.T @ (self.a * n[:, None]) + mixed + mixed.T + self.b.T @ (self.b * tt[:, None])

    def _std(self, squares: float, total: float) -> float:
        return math.sqrt(max(squares / self.points - (total / self.points) ** 2, 0.0))

    def additive(self, trend_scale: float, season_scale: float):
        """(trend weights, season weights, residual deviation): ridge, sigma, ridge with that sigma."""
        k = len(self.target_t)
        gram = np.block([[self.gram_t, self.cross], [self.cross.T, self.gram_f]])
        target = np.r_[self.target_t, self.target_f]
        sums = np.r_[self.a.T @ self.n + self.b.T @ self.t, self.f.T @ self.n]
        penalty = np.r_[0.0, 0.0, np.full(k - 2, trend_scale ** -2.0), np.full(len(target) - k, season_scale ** -2.0)]
        sigma2 = 1e-4
        for _ in range(2):
            w = _ridge(gram, target, sigma2 * penalty)
            sigma = self._std(self.sum_yy - 2 * w @ target + w @ gram @ w, self.sum_y - sums @ w)
            sigma2 = max(sigma ** 2, 1e-8)
        return w[:k], w[k:], sigma

    def multiplicative(self, trend_scale: float, season_scale: float):
        """The same for ``trend * (1 + season)``: the trend alone, then the season of ``y - trend`` in columns ``trend * season``."""
        k = len(self.target_t)
        penalty_t, penalty_f = np.r_[0.0, 0.0, np.full(k - 2, trend_scale ** -2.0)], np.full(self.f.shape[1], season_scale ** -2.0)
        sigma2 = 1e-4
        for _ in range(2):
            w = _ridge(self.gram_t, self.target_t, sigma2 * penalty_t)
            a, b = self.a @ w, self.b @ w                       # the trend in a cell: a + b t
            g, gg = a * self.n + b * self.t, a * a * self.n + 2 * a * b * self.t + b * b * self.tt
            gy = a * self.y + b * self.ty
            beta = _ridge(self.f.T @ (self.f * gg[:, None]), self.f.T @ (gy - gg), sigma2 * penalty_f)
            season = 1.0 + self.f @ beta
            sigma = self._std(self.sum_yy - 2 * season @ gy + season ** 2 @ gg, self.sum_y - season @ g)
            sigma2 = max(sigma ** 2, 1e-8)
        return w, beta, sigma

    def solve(self, params: dict):
        mode = params.get("seasonality_mode", "additive")
        fit = self.multiplicative if mode == "multiplicative" else self.additive
        return fit(float(params["changepoint_prior_scale"]), float(params["seasonality_prior_scale"]))


def solved_model(cells: dict, segment, changepoints, t0_seconds: float, params: dict) -> dict:
    """Model columns (up to the time columns) from the cells of one series; ``changepoints`` in seconds since ``t0``."""
    span, y_scale = max(float(np.max(cells["u_max"])), 1.0), float(np.max(cells["y_max"])) or 1.0
    m = Moments(cells, segment, changepoints, span, y_scale)
    w, beta, sigma = m.solve(params)
    return {
        "t0": float(t0_seconds), "t_span": span, "y_scale": y_scale, "mode": params.get("seasonality_mode", "additive"),
        "k": float(w[0]), "m": float(w[1]), "changepoints": m.changepoints.tolist(), "deltas": w[2:].tolist(),
        "periods": [float(p) for p in m.periods], "orders": [int(o) for o in m.orders],
        "beta_sin": beta[0::2].tolist(), "beta_cos": beta[1::2].tolist(), "sigma": sigma * y_scale, "n_points": int(m.points),
    }


def _columns(packed, names) -> dict:
    """Arrays of the fields of an array of structs."""
    return {name: np.array([c[name] for c in packed]) for name in names}


_CELL_NAMES = ("second", "n", "u", "uu", "y", "uy", "yy", "y_max", "u_max")


# ---------------------------------------------------------------- P1
def fit_forecast(series: DataFrame, params: dict | None = None, keys=(), ts: str = "timestamp",
                 value: str = "value") -> DataFrame:
    """One model row per series; a series under 48 points gives a row with status ``short`` and no parameters.

    Rows without a value are no points, so a series may be announced by one.
    Times count in whole seconds.
    """
    p = {**DEFAULT_PARAMS, **(params or {})}
    keys = tuple(keys)
    if not keys:  # one series: a constant key keeps the model joinable
        series = series.withColumn("_all", F.lit(0))
        keys = ("_all",)
    # one shuffle: ordering, sums and joins below are all by series
    series = spread_for_python(series.select(*keys, ts, value), *keys)
    announced = series.select(*keys).distinct()
    enough = lambda df: df.filter(F.col("n") >= MIN_TRAINING_POINTS)
    points = ordered_points(series, keys, ts, value).withColumn("places", changepoint_places(F.col("n")))
    facts = points.groupBy(*keys).agg(
        F.max("n").alias("n_points"), F.min("ts").alias("train_start"), F.max("ts").alias("train_end"),
        F.sort_array(F.collect_list("ts")).alias("history_ts"),
        F.sort_array(F.collect_list(F.when(F.array_contains("places", F.col("place")), F.col("u")))).alias("cps"))
    cells = enough(points).withColumn("segment", segment_of(F.col("place"), F.col("places"))).groupBy(*keys, "segment", "second").agg(*cell_sums())
    # sums, facts and the series' mere names meet in one grouping, so no join is needed
    cell = F.struct("segment", *_CELL_NAMES)
    start = F.unix_seconds(F.col("train_start").cast("timestamp")).cast("double").alias("t0")
    fact = F.struct("n_points", "train_start", "train_end", "history_ts", "cps", start)
    rows = cells.select(*keys, cell.alias("cell")).unionByName(facts.select(*keys, fact.alias("fact")), allowMissingColumns=True) \
        .unionByName(announced, allowMissingColumns=True)
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("cell")).alias("cells"), F.first("fact", ignorenulls=True).alias("fact"))
    kept = ("train_start", "train_end", "history_ts", "status", "n_points")
    solved = T.StructType([f for f in MODEL_SCHEMA.fields if f.name not in kept])

    @F.pandas_udf(solved)
    def solve(cells: pd.Series, cps: pd.Series, t0: pd.Series) -> pd.DataFrame:
        out = []
        for packed, places, first in zip(cells, cps, t0):
            if packed is None or not len(packed):
                out.append(dict.fromkeys(solved.names))
                continue
            c = _columns(packed, ("segment", *_CELL_NAMES))
            out.append(solved_model(c, c["segment"], places, first, p))
        return pd.DataFrame(out, columns=solved.names)

    out = spread_for_python(rows, *keys).withColumn("m", solve("cells", "fact.cps", "fact.t0"))
    done = F.size("cells") > 0
    columns = {"n_points": F.coalesce("fact.n_points", F.lit(0)).cast("bigint"), "status": F.when(done, OK).otherwise(SHORT),
               "history_ts": F.when(done, F.col("fact.history_ts")), "train_start": F.col("fact.train_start"), "train_end": F.col("fact.train_end")}
    return out.select(*keys, *[columns.get(f.name, F.col(f"m.{f.name}") if f.name not in kept else None).alias(f.name) for f in MODEL_SCHEMA.fields])


# ---------------------------------------------------------------- P2 (column expressions)
def model_value(ts: F.Column) -> F.Column:
    """Prediction of the model columns in scope at timestamp ``ts`` (pure Spark expressions)."""
    t_sec = F.unix_micros(ts.cast("timestamp")).cast("double") / 1e6
    t = (t_sec - F.col("t0")) / F.col("t_span")
    trend = F.col("k") * t + F.col("m") + F.aggregate(
        F.arrays_zip(F.col("changepoints").alias("c"), F.col("deltas").alias("d")), F.lit(0.0),
        lambda acc, x: acc + x["d"] * F.greatest(F.lit(0.0), t - x["c"]))
    days = t_sec / 86400.0
    season = F.aggregate(
        F.arrays_zip(F.col("periods").alias("p"), F.col("orders").alias("o"),
                     F.col("beta_sin").alias("bs"), F.col("beta_cos").alias("bc")), F.lit(0.0),
        lambda acc, x: acc + x["bs"] * F.sin(F.lit(2.0 * math.pi) * x["o"] * days / x["p"])
        + x["bc"] * F.cos(F.lit(2.0 * math.pi) * x["o"] * days / x["p"]))
    y = F.when(F.col("mode") == "multiplicative", trend * (F.lit(1.0) + season)).otherwise(trend + season)
    return y * F.col("y_scale")


def clip_request(hours: int, past_hours: int = 0) -> tuple:
    """Hours 1..48; past context limited to min(hours // 3, 16)."""
    if not 1 <= hours <= MAX_FORECAST_HOURS:
        raise ValueError(f"Hours must be between 1 and {MAX_FORECAST_HOURS}")
    return hours, max(0, min(past_hours, min(hours // 3, MAX_PAST_CONTEXT_HOURS)))


def forecast(models: DataFrame, as_of, hours: int = 24, past_hours: int = 0, keys=(), ts: str = "timestamp") -> DataFrame:
    """Hourly predictions in ``[as_of - past, as_of + hours]`` with an 80 % band.

    Each model row expands to its own grid: its training timestamps inside
    the window plus hourly steps from the end of training far enough to reach
    ``as_of + hours``; one row per hour (the first) is kept.  Predicted and
    lower values are clamped at 0.  No join: the grid is generated from the
    model row itself.  A series without a model keeps one row, with its
    ``status`` and no timestamp or prediction.
    """
    hours, past = clip_request(hours, past_hours)
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    lo = now - F.make_dt_interval(hours=F.lit(past))
    hi = now + F.make_dt_interval(hours=F.lit(hours))
    since_h = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) -
                                      F.unix_micros(F.col("train_end").cast("timestamp"))).cast("double") / 3.6e9)
    periods = (F.floor(F.lit(float(hours)) + since_h) + 1).cast("int")
    future = F.transform(F.sequence(F.lit(1), periods),
                         lambda i: F.col("train_end") + F.make_dt_interval(hours=i))
    in_window = lambda t: (t >= lo) & (t <= hi)
    grid_ts = F.filter(F.concat(F.col("history_ts"), future), in_window)
    no_grid = F.array(F.lit(None).cast("timestamp_ntz"))
    grid = models.withColumn(ts, F.explode(F.when(F.col("status") == OK, grid_ts).otherwise(no_grid)))
    pred = grid.withColumn("yhat", model_value(F.col(ts)))
    band = F.lit(INTERVAL_Z) * F.col("sigma")
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    out = pred.select(*keys, "status", hour.alias("hour"), F.col(ts).alias("_t"),
                      F.when(F.col("yhat").isNotNull(), F.greatest(F.lit(0.0), F.col("yhat"))).alias("predicted_power"),
                      F.when(F.col("yhat").isNotNull(), F.greatest(F.lit(0.0), F.col("yhat") - band)).alias("lower_bound"),
                      (F.col("yhat") + band).alias("upper_bound"))
    first = out.groupBy(*keys, "status", "hour").agg(F.min_by(F.struct("predicted_power", "lower_bound", "upper_bound"),
                                                    F.col("_t")).alias("r"))
    return first.select(*keys, F.col("hour").alias("timestamp"), "r.predicted_power", "r.lower_bound", "r.upper_bound", "status")


# ---------------------------------------------------------------- P3
def forecast_view(fc: DataFrame, as_of, keys=(), ts: str = "timestamp") -> DataFrame:
    """``is_past`` / ``is_future``, split at the first row at or after the current hour (in both)."""
    now_hour = F.date_trunc("hour", F.lit(str(as_of)).cast("timestamp_ntz")).cast("timestamp_ntz")
    split = fc.filter(F.col(ts) >= now_hour).groupBy(*keys).agg(F.min(ts).alias("_split"))
    j = fc.join(split, list(keys), "left") if keys else fc.withColumn("_split", split.select("_split").scalar())
    s = F.col("_split")
    return j.withColumn("is_past", F.coalesce(F.col(ts) <= s, F.lit(False))) \
        .withColumn("is_future", F.coalesce(F.col(ts) >= s, F.lit(True))).drop("_split")


# ---------------------------------------------------------------- P4
def _grid_rows(grid: dict) -> list:
    names = list(grid)
    return [dict(zip(names, combo)) for combo in product(*grid.values())]


def fold_cells(splits: DataFrame, ts: str = "timestamp", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Sums of the training rows of expanding folds, each row summed once: (cells, folds).

    ``splits`` are the rows of :func:`expanding_splits`.  ``cells`` is (segments, second, sums) where ``segments`` has
    a row's segment in every fold, -1 where it isn't trained on; ``folds`` is (fold, n, changepoints) with changepoints in seconds since
    the first point.
    """
    train = splits.filter(F.col("role") == "train")
    sizes = train.filter(F.col(value).isNotNull()).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    # one row holds all folds: (fold, n, places), in fold order
    plan = sizes.agg(F.sort_array(F.collect_list(F.struct("fold", "n", changepoint_places(F.col("n")).alias("places")))).alias("folds"))
    last = splits.agg(F.max("fold")).scalar()
    points = ordered_points(train.filter(F.col("fold") == last), (), ts, value)  # the last fold's rows hold all others'
    points = points.withColumn("folds", plan.scalar())
    segments = F.transform("folds", lambda f: F.when(F.col("place") < f["n"], segment_of(F.col("place"), f["places"])).otherwise(-1))
    cells = points.withColumn("segments", segments).groupBy("segments", "second").agg(*cell_sums())
    marks = points.select("place", "u", F.explode("folds").alias("f")).filter(F.array_contains("f.places", F.col("place")))
    folds = marks.groupBy("f.fold").agg(F.max("f.n").alias("n"), F.sort_array(F.collect_list("u")).alias("changepoints"))
    return cells, folds


def tune_forecast(series: DataFrame, grid: dict | None = None, n_splits: int = 4, min_train_days: int = 3,
                  validation_days: int = 1, ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Mean validation MAE of every parameter combination over expanding folds.

    Returns the history ``(combo, changepoint_prior_scale, seasonality_prior_scale,
    seasonality_mode, mae, folds, is_best)``; failed combinations get no row.
    The shuffle holds each training row's sums once, whatever the grid.
    """
    combos = _grid_rows(grid or FORECAST_GRID)
    splits = expanding_splits(series.select(ts, value), n_splits, min_train_days, validation_days, ts)
    cells, folds = fold_cells(splits, ts, value)
    start = splits.agg(F.min(F.when((F.col("role") == "train") & F.col(value).isNotNull(), F.col(ts)))).scalar()
    one = cells.agg(F.sort_array(F.collect_list(F.struct("segments", *_CELL_NAMES))).alias("cells"))
    one = one.withColumn("folds", folds.agg(F.sort_array(F.collect_list(F.struct("fold", "changepoints")))).scalar()) \
        .withColumn("t0", F.unix_seconds(start.cast("timestamp")).cast("double"))
    fields = [f for f in MODEL_SCHEMA.fields if f.name not in ("train_start", "train_end", "history_ts", "status", "n_points")]
    kind = T.StructType([T.StructField(n, t) for n, t in (("combo", T.IntegerType()), ("fold", T.IntegerType()))] + fields)

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                rows = []
                if r["cells"] is not None and len(r["cells"]):
                    c = _columns(r["cells"], _CELL_NAMES)
                    segments = np.array([x["segments"] for x in r["cells"]])
                    for i, fold in enumerate(r["folds"]):
                        mine = segments[:, i] >= 0
                        part = {k: v[mine] for k, v in c.items()}
                        for j, combo in enumerate(combos):
                            try:
                                model = solved_model(part, segments[mine, i], fold["changepoints"], r["t0"], combo)
                            except np.linalg.LinAlgError:  # a failed combination is skipped, as in grid search
                                continue
                            rows.append({"combo": j, "fold": int(fold["fold"]), **model})
                yield pd.DataFrame(rows, columns=[f.name for f in kind.fields])

    models = one.mapInPandas(solve, kind).withColumnRenamed("fold", "m_fold")  # at most folds x combinations rows
    held_out = splits.filter((F.col("role") == "validation") & F.col(value).isNotNull()).select("fold", ts, value)
    errors = held_out.join(models, F.col("fold") == F.col("m_fold")).select("combo", "fold", F.abs(F.col(value) - model_value(F.col(ts))).alias("e"))
    per_fold = errors.groupBy("combo", "fold").agg(exact_avg("e").alias("mae"))
    names = F.array(*[F.struct(F.lit(float(c["changepoint_prior_scale"])).alias("cps"), F.lit(float(c["seasonality_prior_scale"])).alias("sps"),
                               F.lit(c["seasonality_mode"]).alias("mode")) for c in combos])
    hist = per_fold.groupBy("combo").agg(exact_avg("mae").alias("mae"), F.count("fold").alias("folds")).withColumn("c", F.element_at(names, F.col("combo") + 1))
    best = hist.agg(F.min_by("combo", F.struct("mae", "combo"))).scalar()
    return hist.select("combo", F.col("c.cps").alias("changepoint_prior_scale"), F.col("c.sps").alias("seasonality_prior_scale"),
                       F.col("c.mode").alias("seasonality_mode"), "mae", "folds", (F.col("combo") == best).alias("is_best"))


def best_params(history: DataFrame) -> DataFrame:
    """P4 winner over given scores: least MAE (ties: first in grid order), merged over the defaults.

    A parameter that the grid didn't vary (no such column, or NULL) has its
    default value.
    """
    known = [F.coalesce(F.col(n), F.lit(d)).alias(n) if n in history.columns else F.lit(d).alias(n) for n, d in DEFAULT_PARAMS.items()]
    win = history.select("combo", *known, "mae").agg(
        F.min_by(F.struct("combo", *DEFAULT_PARAMS, "mae"), F.struct("mae", "combo")).alias("w"))
    return win.select("w.*")


def tuning_record(history: DataFrame, tuned_at) -> DataFrame:
    """The saved result of a tuning run: winner's parameters, its MAE, combinations tried, ``tuned_at`` (one row)."""
    tried = history.agg(F.count("combo")).scalar()
    at = tuned_at if isinstance(tuned_at, F.Column) else F.lit(tuned_at).cast("timestamp_ntz")
    return best_params(history).select(*DEFAULT_PARAMS, F.col("mae").alias("best_mae"), tried.alias("n_combos"), at.alias("tuned_at"))


def saved_params(record: DataFrame | None) -> dict:
    """Parameters of a saved tuning record (its newest row), or the defaults; one row reaches the driver."""
    row = None if record is None else record.orderBy(F.col("tuned_at").desc()).select(*DEFAULT_PARAMS).first()
    return dict(DEFAULT_PARAMS) if row is None else {**DEFAULT_PARAMS, **{k: v for k, v in row.asDict().items() if v is not None}}
