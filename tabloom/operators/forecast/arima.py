"""ARIMA(p, d, q) per series with diagnostics (FCT-12, FCT-12a).

Each series is one ``applyInPandas`` group (a per-period series, so its length
is bounded by the number of periods). ``method="exact"`` maximises the exact
Gaussian likelihood of the differenced series (:mod:`.kalman`), started from the
conditional fit; ``method="css"`` is the conditional fit alone (Hannan–Rissanen
start values, then damped Gauss–Newton on the conditional squares). Intervals
use the ψ-weights of the integrated model.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import cdf
from tabloom.functions.expressions import OperatorError, as_list as _as_list, present, qcol, require_columns
from tabloom.functions.residual_tests import normality, unit_root_pvalue
from tabloom.operators.forecast import kalman
from tabloom.operators.forecast.smoothing import without_nan


def css_residuals(w: np.ndarray, phi: np.ndarray, theta: np.ndarray, mu: float) -> np.ndarray:
    p, q = len(phi), len(theta)
    x = w - mu
    e = np.zeros(len(x))
    for t in range(p, len(x)):
        ar = np.dot(phi, x[t - p:t][::-1]) if p else 0.0
        ma = sum(theta[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= 0)
        e[t] = x[t] - ar - ma
    return e[p:]


def _ols(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(X, y, rcond=None)[0]


def hannan_rissanen(w: np.ndarray, p: int, q: int, mu: float):
    x = w - mu
    n = len(x)
    m = min(max(p, q) + 3, max(1, n // 4))
    if q > 0 and n > m + 2:
        Xl = np.column_stack([x[m - i - 1:n - i - 1] for i in range(m)])
        a = _ols(Xl, x[m:])
        e = np.zeros(n)
        e[m:] = x[m:] - Xl @ a
    else:
        e = np.zeros(n)
    k = max(p, q, m if q > 0 else p)
    cols = [x[k - i - 1:n - i - 1] for i in range(p)] + [e[k - j - 1:n - j - 1] for j in range(q)]
    if not cols or n - k < len(cols) + 1:
        return np.zeros(p), np.zeros(q)
    b = _ols(np.column_stack(cols), x[k:])
    return b[:p], b[p:]


def fit_css(w: np.ndarray, p: int, q: int, with_mean: bool, iters: int = 50):
    mu = float(np.mean(w)) if with_mean else 0.0
    phi, theta = hannan_rissanen(w, p, q, mu)
    params = np.concatenate([phi, theta, [mu] if with_mean else []])

    def unpack(v):
        return v[:p], v[p:p + q], (v[p + q] if with_mean else 0.0)

    def resid(v):
        a, b, m = unpack(v)
        r = css_residuals(w, a, b, m)
        return np.where(np.isfinite(r), r, 1e6)

    r0 = resid(params)
    ssr = float(r0 @ r0)
    lam = 1e-3
    for _ in range(iters):
        if len(params) == 0:
            break
        eps = 1e-6
        J = np.column_stack([(resid(params + eps * np.eye(len(params))[i]) - r0) / eps
                             for i in range(len(params))])
        g = J.T @ r0
        H = J.T @ J
        step = np.linalg.solve(H + lam * np.diag(np.diag(H) + 1e-12), -g)
        cand = params + step
        rc = resid(cand)
        s = float(rc @ rc)
        if s < ssr:
            params, r0, ssr = cand, rc, s
            lam = max(lam / 10, 1e-9)
            if abs(step).max() < 1e-8:
                break
        else:
            lam *= 10
            if lam > 1e8:
                break
    a, b, m = unpack(params)
    return a, b, m, r0


def psi_weights(phi, theta, d: int, h: int) -> np.ndarray:
    ar = np.array([1.0] + [-x for x in phi])
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    ma = np.array([1.0] + list(theta))
    psi = np.zeros(h)
    for j in range(h):
        v = ma[j] if j < len(ma) else 0.0
        for i in range(1, min(j, len(ar) - 1) + 1):
            v -= ar[i] * psi[j - i]
        psi[j] = v
    return psi


def forecast(y: np.ndarray, d: int, phi, theta, mu, resid: np.ndarray, h: int) -> np.ndarray:
    w = np.diff(y, n=d) if d else y.copy()
    x = list(w - mu)
    e = list(np.concatenate([np.zeros(len(w) - len(resid)), resid]))
    p, q = len(phi), len(theta)
    out = []
    for _ in range(h):
        ar = sum(phi[i] * x[-1 - i] for i in range(p)) if p else 0.0
        ma = sum(theta[j] * e[-1 - j] for j in range(q)) if q else 0.0
        nxt = ar + ma
        x.append(nxt)
        e.append(0.0)
        out.append(nxt + mu)
    return integrated(y, d, np.array(out))


def integrated(y: np.ndarray, d: int, fc: np.ndarray) -> np.ndarray:
    """Forecasts of the series from those of its ``d``-th differences."""
    for k in range(d):
        last = np.diff(y, n=d - 1 - k)[-1] if d - 1 - k > 0 else y[-1]
        fc = last + np.cumsum(fc)
    return fc


def adf_test(y: np.ndarray, max_lag: int | None = None):
    """Augmented Dickey-Fuller test with a constant: the lag with the least AIC on
    the rows that all lags have, then the statistic on all rows of that lag."""
    n = len(y)
    if n < 8:
        return float("nan"), float("nan")
    max_lag = max_lag if max_lag is not None else math.ceil(12 * (n / 100) ** 0.25)
    max_lag = max(0, min(max_lag, n // 2 - 2))
    dy = np.diff(y)

    def regression(lag: int, skip: int):
        rows = len(dy) - skip
        x = np.column_stack([y[skip:-1]] + [dy[skip - i:len(dy) - i] for i in range(1, lag + 1)] + [np.ones(rows)])
        b, *_ = np.linalg.lstsq(x, dy[skip:], rcond=None)
        return x, b, dy[skip:] - x @ b

    def criterion(lag: int) -> float:
        x, _, e = regression(lag, max_lag)
        return len(e) * math.log(max(e @ e / len(e), 1e-300)) + 2 * x.shape[1]

    lag = min(range(max_lag + 1), key=criterion)
    x, b, e = regression(lag, lag)
    free_rows = len(e) - x.shape[1]
    if free_rows <= 0 or np.linalg.matrix_rank(x) < x.shape[1]:
        return float("nan"), float("nan")
    var = e @ e / free_rows * np.linalg.inv(x.T @ x)[0, 0]
    if not var > 0:  # constant
        return float("nan"), float("nan")
    stat = float(b[0] / math.sqrt(var))
    return stat, unit_root_pvalue(stat)


def ljung_box(e: np.ndarray, lags: int):
    n = len(e)
    if n < 3 or lags < 1:
        return float("nan"), float("nan")
    x = e - e.mean()
    den = x @ x
    q = 0.0
    for k in range(1, lags + 1):
        rk = (x[k:] @ x[:-k]) / den if den > 0 else 0.0
        q += rk * rk / (n - k)
    q *= n * (n + 2)
    return float(q), cdf.chi2_sf(q, lags)


ARIMA_SCHEMA = ("p int, d int, q int, ar_coef array<double>, ma_coef array<double>, sigma2 double, "
                "loglik double, aic double, bic double, n_train long, n_test long, mape double, mae double, "
                "rmse double, forecast array<double>, lower array<double>, upper array<double>, "
                "adf_stat double, adf_p double, ljung_box double, ljung_box_p double, durbin_watson double, "
                "jarque_bera_p double, normality_p double, resid_mean double, resid_std double, error string")


def arima_group(pdf: pd.DataFrame, order, test_size: float, confidence: float, method: str = "exact") -> pd.DataFrame:
    p, d, q = order
    pdf = pdf.sort_values("time")
    y = pdf["value"].to_numpy(dtype=float)
    n_train = int(len(y) * (1 - test_size))
    train, test = y[:n_train], y[n_train:]
    need = p + q + d + 3
    if n_train < need:
        return without_nan(pd.DataFrame([{"p": p, "d": d, "q": q, "n_train": n_train, "n_test": len(test),
                                          "error": f"series too short: {n_train} training rows, {need} needed"}],
                                        columns=[c.split()[0] for c in ARIMA_SCHEMA.split(", ")]))
    w = np.diff(train, n=d) if d else train
    a, b, mu, e = fit_css(w, p, q, with_mean=(d == 0))
    h = len(test)
    if method == "exact" and np.std(w) > 0:
        a, b, fit = kalman.fit_exact(w, p, q, d == 0, a, b)
        e, mu, sigma2, ll, n_eff = fit["errors"], fit["mean"], fit["sigma2"], fit["loglik"], len(w)
        fc = integrated(train, d, kalman.predictions(fit, a, b, h)) if h else np.array([])
    else:
        n_eff = len(e)
        sigma2 = float(e @ e / n_eff) if n_eff else float("nan")
        ll = -0.5 * n_eff * (math.log(2 * math.pi * sigma2) + 1) if sigma2 > 0 else float("nan")
        fc = forecast(train, d, a, b, mu, e, h) if h else np.array([])
    k = p + q + (1 if d == 0 else 0) + 1
    z = cdf.norm_ppf(0.5 + confidence / 2)
    psi = psi_weights(a, b, d, max(h, 1))
    se = np.sqrt(sigma2 * np.cumsum(psi ** 2))[:h]
    nz = test != 0
    mape = float(np.mean(np.abs((fc[nz] - test[nz]) / test[nz]))) if nz.any() else float("nan")
    adf_stat, adf_p = adf_test(train)
    lb, lb_p = ljung_box(e, min(10, max(1, n_eff // 5)))
    dw = float(np.sum(np.diff(e) ** 2) / (e @ e)) if n_eff > 1 and e @ e > 0 else float("nan")
    m, s = float(np.mean(e)), float(np.std(e, ddof=1)) if n_eff > 1 else float("nan")
    if n_eff > 2 and s > 0:
        c = e - m
        sk = np.mean(c ** 3) / np.mean(c ** 2) ** 1.5
        ku = np.mean(c ** 4) / np.mean(c ** 2) ** 2
        jb = n_eff / 6 * (sk ** 2 + (ku - 3) ** 2 / 4)
        jb_p = cdf.chi2_sf(float(jb), 2)
    else:
        jb_p = float("nan")
    row = {"p": p, "d": d, "q": q, "ar_coef": [float(x) for x in a], "ma_coef": [float(x) for x in b],
           "sigma2": sigma2, "loglik": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * math.log(max(n_eff, 1)),
           "n_train": n_train, "n_test": h, "mape": mape,
           "mae": float(np.mean(np.abs(fc - test))) if h else float("nan"),
           "rmse": float(np.sqrt(np.mean((fc - test) ** 2))) if h else float("nan"),
           "forecast": [float(x) for x in fc], "lower": [float(x) for x in fc - z * se],
           "upper": [float(x) for x in fc + z * se], "adf_stat": adf_stat, "adf_p": adf_p,
           "ljung_box": lb, "ljung_box_p": lb_p, "durbin_watson": dw, "jarque_bera_p": jb_p,
           "normality_p": normality(e), "resid_mean": m, "resid_std": s, "error": None}
    return without_nan(pd.DataFrame([row], columns=[c.split()[0] for c in ARIMA_SCHEMA.split(", ")]))


def arima(df: DataFrame, target: str, time_column: str = "time", series_keys=(), order=(2, 1, 1),
          test_size: float = 0.2, confidence_level: float = 0.95, method: str = "exact") -> DataFrame:
    """FCT-12/12a: one row per series with coefficients, fit criteria, test
    metrics, forecasts with intervals and residual diagnostics; a series that is
    too short has an ``error`` text instead. Missing values are left out."""
    keys = _as_list(series_keys)
    if not keys:
        raise OperatorError("arima needs series_keys: a table of one series is one task")
    require_columns(df, keys + [target, time_column])
    if method not in ("exact", "css"):
        raise OperatorError("method must be 'exact' or 'css'")
    base = df.select(*[qcol(k) for k in keys], qcol(time_column).alias("time"),
                     present(df, target).cast("double").alias("value")).filter(F.col("value").isNotNull())
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)

    def fn(key, pdf):
        out = arima_group(pdf, tuple(order), test_size, confidence_level, method)
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    return base.groupBy(*[qcol(k) for k in keys]).applyInPandas(fn, key_schema + ", " + ARIMA_SCHEMA)


def residual_diagnostics_sql_form(df: DataFrame, resid: str, order_by, by=()) -> DataFrame:
    """Durbin-Watson, mean and std of residuals as window/aggregate SQL."""
    from pyspark.sql import Window
    keys = _as_list(by)
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(*[qcol(o) for o in _as_list(order_by)])
    e = qcol(resid)
    diff = e - F.lag(e).over(w)
    x = df.select(*[qcol(k) for k in keys], e.alias("e"), diff.alias("de"))
    return x.groupBy(*[qcol(k) for k in keys]).agg(
        (F.sum(F.col("de") * F.col("de")) / F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"),
        F.avg("e").alias("resid_mean"), F.stddev_samp("e").alias("resid_std"))
