"""Exact Gaussian likelihood of ARMA models by a state space filter (FCT-12).

The state of an ARMA(p, q) series holds ``r = max(p, q + 1)`` values; its start
covariance solves the Lyapunov equation, so the likelihood is the exact one of
a stationary series. The variance and the mean are concentrated out (the mean
is linear: the filter runs over the series and a column of ones). Coefficients
are searched through partial autocorrelations, which keeps the model stationary
and invertible.
"""

from __future__ import annotations

import math

import numpy as np

from tabloom.functions.lbfgs import minimise

SETTLED = 1e-13


def system(phi, theta) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and disturbance vector."""
    r = max(len(phi), len(theta) + 1)
    t = np.zeros((r, r))
    t[:len(phi), 0] = phi
    t[np.arange(r - 1), np.arange(1, r)] = 1.0
    return t, np.r_[1.0, theta, np.zeros(r - 1 - len(theta))]


def start_covariance(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    r = len(d)
    return np.linalg.solve(np.eye(r * r) - np.kron(t, t), np.outer(d, d).ravel()).reshape(r, r)


def innovations(x: np.ndarray, phi, theta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors of the columns of ``x``, their variances in units of sigma^2,
    and the state after the last value."""
    t, d = system(phi, theta)
    p, a = start_covariance(t, d), np.zeros((len(d), x.shape[1]))
    shock = np.outer(d, d)
    errors, sizes, settled = np.empty_like(x), np.ones(len(x)), False
    for i, row in enumerate(x):
        if not settled:
            f = p[0, 0]
            gain = t @ p[:, 0] / f
            step = t @ p @ t.T + shock - np.outer(gain, gain) * f
            settled = abs(f - 1.0) < SETTLED and np.abs(step - p).max() < SETTLED
            p = step
        sizes[i] = f
        errors[i] = row - a[0]
        a = t @ a + gain[:, None] * errors[i]
    return errors, sizes, a


def likelihood(w: np.ndarray, phi, theta, with_mean: bool) -> dict:
    """Log-likelihood with the best mean and variance, those two, the one-step
    errors and the last state of the centred series."""
    n = len(w)
    e, f, a = innovations(np.column_stack([w, np.ones(n)]) if with_mean else w[:, None], phi, theta)
    mean = float((e[:, 1] * e[:, 0] / f).sum() / (e[:, 1] ** 2 / f).sum()) if with_mean else 0.0
    v = e[:, 0] - mean * e[:, 1] if with_mean else e[:, 0]
    sigma2 = float((v * v / f).mean())
    ll = -0.5 * (n * (math.log(2 * math.pi * sigma2) + 1) + np.log(f).sum()) if sigma2 > 0 else float("nan")
    return {"loglik": float(ll), "mean": mean, "sigma2": sigma2, "errors": v, "state": a[:, 0] - mean * a[:, 1] if with_mean else a[:, 0]}


def stationary(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary model from free numbers (as partial autocorrelations)."""
    out = np.zeros(0)
    for r in u / np.sqrt(1 + u * u):
        out = np.r_[out - r * out[::-1], r]
    return out


def free(phi: np.ndarray) -> np.ndarray | None:
    """Inverse of :func:`stationary`; None outside the stationary region."""
    left, out = np.asarray(phi, float), []
    while len(left):
        r = left[-1]
        if abs(r) >= 0.999:
            return None
        out.append(r / math.sqrt(1 - r * r))
        left = (left[:-1] + r * left[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def fit_exact(w: np.ndarray, p: int, q: int, with_mean: bool, phi0, theta0) -> tuple[np.ndarray, np.ndarray, dict]:
    """Maximum likelihood coefficients, started from given ones and from zero."""
    scale = float(np.std(w)) or 1.0
    x = w / scale

    def parts(u):
        return stationary(u[:p]), -stationary(u[p:])

    def value(u):
        ll = likelihood(x, *parts(u), with_mean)["loglik"]
        return -ll / len(x) if math.isfinite(ll) else 1e10

    def both(u):
        step = 1e-6 * np.maximum(np.abs(u), 1.0)
        return value(u), np.array([(value(u + h) - value(u - h)) / (2 * s) for s, h in zip(step, np.diag(step))])

    starts = [np.zeros(p + q)]
    given = (free(np.asarray(phi0, float)), free(-np.asarray(theta0, float)))
    if all(g is not None for g in given):
        starts.insert(0, np.concatenate(given))
    found = [minimise(both, s, 100, 1e-12) for s in starts] if p + q else starts
    phi, theta = parts(min(found, key=value))
    return phi, theta, likelihood(w, phi, theta, with_mean)


def predictions(fit: dict, phi, theta, steps: int) -> np.ndarray:
    t, _ = system(phi, theta)
    a, out = fit["state"], []
    for _ in range(steps):
        out.append(a[0] + fit["mean"])
        a = t @ a
    return np.array(out)
