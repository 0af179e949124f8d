"""Forecast fits row by row in numpy: what the sums of gridlens.operators.forecast must give."""

import math

import numpy as np

from gridlens.operators.forecast import _fourier


def _ridge(x, y, penalty):
    return np.linalg.solve(x.T @ x + np.diag(penalty + 1e-9), x.T @ y)


def fit_rows(ts, values, params):
    """Model columns of one series of (naive datetime, value) rows."""
    order = np.argsort(ts.to_numpy())
    t_sec = ts.to_numpy()[order].astype("datetime64[us]").astype(np.int64) / 1e6
    y = values.to_numpy()[order].astype(float)
    n = len(y)
    span = max(t_sec[-1] - t_sec[0], 1.0)
    t, y_scale = (t_sec - t_sec[0]) / span, float(np.max(np.abs(y))) or 1.0
    y = y / y_scale
    ncp = min(25, max(n - 2, 0))
    hist = int(math.floor(n * 0.8))
    cps = t[np.linspace(0, max(hist - 1, 0), ncp + 1).round().astype(int)[1:]]
    trend_x = np.column_stack([t, np.ones(n)] + [np.maximum(0.0, t - c) for c in cps])
    four, periods, orders = _fourier(t_sec / 86400.0)
    pt = np.r_[0.0, 0.0, np.full(ncp, params["changepoint_prior_scale"] ** -2.0)]
    pf = np.full(four.shape[1], params["seasonality_prior_scale"] ** -2.0)
    sigma2 = 1e-4
    for _ in range(2):
        if params["seasonality_mode"] == "additive":
            x = np.column_stack([trend_x, four])
            both = _ridge(x, y, sigma2 * np.r_[pt, pf])
            w, beta, fitted = both[:len(pt)], both[len(pt):], x @ both
        else:
            w = _ridge(trend_x, y, sigma2 * pt)
            trend = trend_x @ w
            beta = _ridge(four * trend[:, None], y - trend, sigma2 * pf)
            fitted = trend * (1.0 + four @ beta)
        sigma = float(np.std(y - fitted))
        sigma2 = max(sigma ** 2, 1e-8)
    return {"t0": t_sec[0], "t_span": span, "y_scale": y_scale, "mode": params["seasonality_mode"], "k": w[0], "m": w[1], "changepoints": cps,
            "deltas": w[2:], "periods": periods, "orders": orders, "beta_sin": beta[0::2], "beta_cos": beta[1::2], "sigma": sigma * y_scale}


def predict_rows(model, ts):
    t_sec = ts.to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
    t = (t_sec - model["t0"]) / model["t_span"]
    trend = model["k"] * t + model["m"]
    for c, d in zip(model["changepoints"], model["deltas"]):
        trend = trend + d * np.maximum(0.0, t - c)
    days = t_sec / 86400.0
    season = np.zeros_like(t)
    for p, o, bs, bc in zip(model["periods"], model["orders"], model["beta_sin"], model["beta_cos"]):
        w = 2.0 * math.pi * o * days / p
        season += bs * np.sin(w) + bc * np.cos(w)
    y = trend * (1.0 + season) if model["mode"] == "multiplicative" else trend + season
    return y * model["y_scale"]
