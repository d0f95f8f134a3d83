"""Exact ARMA likelihood against the dense Gaussian one; residual tests against published values."""

import math

import numpy as np
import pandas as pd
import pytest

from tabloom.functions import residual_tests as R
from tabloom.operators.forecast import arima, kalman


def autocovariance(phi, theta, n):
    t, d = kalman.system(phi, theta)
    psi, a = [], d
    for _ in range(4000):
        psi.append(a[0])
        a = t @ a
    psi = np.array(psi)
    return np.array([psi[:len(psi) - k] @ psi[k:] for k in range(n)])


def dense(w, phi, theta, with_mean):
    n = len(w)
    g = autocovariance(phi, theta, n)
    s = g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    inv = np.linalg.inv(s)
    one = np.ones(n)
    mean = one @ inv @ w / (one @ inv @ one) if with_mean else 0.0
    x = w - mean
    sigma2 = x @ inv @ x / n
    return -0.5 * (n * (math.log(2 * math.pi * sigma2) + 1) + np.linalg.slogdet(s)[1]), mean, sigma2


def simulated(n, phi, theta, seed=1, mean=0.0):
    r = np.random.default_rng(seed)
    e = r.normal(size=n + 300)
    x = np.zeros(n + 300)
    for t in range(10, n + 300):
        x[t] = sum(p * x[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(q * e[t - 1 - j] for j, q in enumerate(theta))
    return x[300:] + mean


@pytest.mark.parametrize("phi,theta", [([], []), ([.6], []), ([], [.4]), ([.5, -.3], [.4]), ([.2], [.3, -.2, .1]), ([1.2, -.5, .1], [])])
@pytest.mark.parametrize("with_mean", [True, False])
def test_likelihood_equals_dense(phi, theta, with_mean):
    w = simulated(80, phi, theta, mean=3.0 if with_mean else 0.0)
    got = kalman.likelihood(w, np.array(phi), np.array(theta), with_mean)
    ll, mean, sigma2 = dense(w, phi, theta, with_mean)
    assert abs(got["loglik"] - ll) < 1e-8 and abs(got["mean"] - mean) < 1e-9 and abs(got["sigma2"] - sigma2) < 1e-9


@pytest.mark.parametrize("phi,theta", [([.6], []), ([.5, -.3], [.4]), ([], [-.5])])
def test_fit_is_a_maximum(phi, theta):
    w = simulated(400, phi, theta, seed=7, mean=2.0)
    a, b, fit = kalman.fit_exact(w, len(phi), len(theta), True, np.zeros(len(phi)), np.zeros(len(theta)))
    assert np.abs(np.r_[a, b] - np.r_[phi, theta]).max() < 0.2
    for i in range(len(phi) + len(theta)):
        for step in (-1e-3, 1e-3):
            v = np.r_[a, b]
            v[i] += step
            assert kalman.likelihood(w, v[:len(phi)], v[len(phi):], True)["loglik"] <= fit["loglik"] + 1e-9


def test_predictions_are_conditional_means():
    phi, theta = np.array([.5, .2]), np.array([.4])
    w = simulated(60, phi, theta, seed=2)
    fit = kalman.likelihood(w, phi, theta, False)
    g = autocovariance(phi, theta, 70)
    s = g[np.abs(np.subtract.outer(np.arange(65), np.arange(65)))]
    assert np.allclose(kalman.predictions(fit, phi, theta, 5), s[60:, :60] @ np.linalg.solve(s[:60, :60], w), atol=1e-9)


def test_partial_autocorrelations_go_both_ways():
    u = np.array([.3, -1.2, .7])
    assert np.allclose(kalman.free(kalman.stationary(u)), u)
    assert kalman.free(np.array([1.1])) is None


def test_exact_beats_conditional_in_the_group():
    y = np.cumsum(simulated(120, [.5], [.3], seed=4)) + 50
    pdf = pd.DataFrame({"time": range(120), "value": y})
    exact, css = (arima.arima_group(pdf, (1, 1, 1), .2, .95, m).iloc[0] for m in ("exact", "css"))
    w = np.diff(y[:96])
    at = lambda r: kalman.likelihood(w, np.array(r.ar_coef), np.array(r.ma_coef), False)["loglik"]
    assert exact.loglik >= at(css) - 1e-9 and abs(exact.loglik - at(exact)) < 1e-6
    assert abs(exact.aic - (6 - 2 * exact.loglik)) < 1e-9
    assert 0 <= exact.normality_p <= 1
    flat = arima.arima_group(pd.DataFrame({"time": range(40), "value": [3.0] * 40}), (1, 1, 0), .2, .95).iloc[0]
    assert flat.forecast == [3.0] * 8


def test_shapiro_published_values():
    w, p = R.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.7888) < 1e-4 and abs(p - 0.0067) < 1e-4
    assert R.shapiro_wilk([1, 1, 1])[0] != R.shapiro_wilk([1, 1, 1])[0]  # NaN
    r = np.random.default_rng(3)
    assert R.shapiro_wilk(r.normal(size=500))[1] > 0.01 > R.shapiro_wilk(r.exponential(size=500))[1]
    assert 0 < R.shapiro_wilk([1.0, 2.0, 4.0])[1] < 1
    assert R.normality(r.normal(size=6000)) > 0.001 > R.normality(r.normal(size=6000) + .2)


@pytest.mark.parametrize("stat,p", [(-3.43, .01), (-2.86, .05), (-2.57, .10), (-0.44, .90), (-0.07, .95), (0.60, .99)])
def test_unit_root_quantiles(stat, p):
    """The asymptotic quantiles of the Dickey-Fuller distribution."""
    assert abs(R.unit_root_pvalue(stat) - p) < 0.0035
    assert R.unit_root_pvalue(-30) == 0 and R.unit_root_pvalue(5) == 1
