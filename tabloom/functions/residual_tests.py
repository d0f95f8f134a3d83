"""Tests of residuals: Shapiro-Wilk, Kolmogorov-Smirnov and unit-root p-values."""

from __future__ import annotations

import math

import numpy as np

from tabloom.functions import cdf

# Polynomials of Royston's approximation (AS R94), by rising power.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)

# MacKinnon's response surface of the Dickey-Fuller distribution
# (constant, one series), by rising power, and the range it holds for.
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
UNIT_ROOT_RANGE = (-18.83, -1.61, 2.74)


def _poly(c, x: float) -> float:
    return sum(v * x ** i for i, v in enumerate(c))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the order statistics, largest first."""
    half = n // 2
    if n == 3:
        return np.array([math.sqrt(0.5)])
    m = np.array([-cdf.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
    total = 2 * float(m @ m)
    root, u = math.sqrt(total), 1 / math.sqrt(n)
    a = np.empty(half)
    a[0] = _poly(WEIGHT_LAST, u) + m[0] / root
    if n > 5:
        a[1] = _poly(WEIGHT_NEXT, u) + m[1] / root
        fixed = 2
    else:
        fixed = 1
    scale = math.sqrt((total - 2 * float(m[:fixed] @ m[:fixed])) / (1 - 2 * float(a[:fixed] @ a[:fixed])))
    a[fixed:] = m[fixed:] / scale
    return a


def shapiro_wilk(x) -> tuple[float, float]:
    """W and its p-value for 3 to 5,000 values (NaN otherwise, and for equal values)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return float("nan"), float("nan")
    a = shapiro_weights(n)
    spread = x - x.mean()
    w = min(float(a @ (x[::-1][:len(a)] - x[:len(a)])) ** 2 / float(spread @ spread), 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        g = _poly(SMALL_GAMMA, n)
        if y >= g:
            return w, 0.0
        y, mean, sd = -math.log(g - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        u = math.log(n)
        mean, sd = _poly(LARGE_MEAN, u), math.exp(_poly(LARGE_LOG_SD, u))
    return w, 1 - cdf.norm_cdf((y - mean) / sd)


def kolmogorov_normal(x) -> tuple[float, float]:
    """Largest distance from the standard normal distribution and its p-value."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if not n:
        return float("nan"), float("nan")
    f = np.array([cdf.norm_cdf(v) for v in x])
    d = float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101)) if t > 0.2 else 1.0
    return d, min(max(p, 0.0), 1.0)


def normality(x) -> float:
    """p-value by Shapiro-Wilk up to 5,000 values, by Kolmogorov-Smirnov beyond."""
    return shapiro_wilk(x)[1] if len(x) <= 5000 else kolmogorov_normal(x)[1]


def unit_root_pvalue(stat: float) -> float:
    """p-value of a Dickey-Fuller statistic (constant, no trend)."""
    low, middle, high = UNIT_ROOT_RANGE
    if math.isnan(stat):
        return float("nan")
    if stat <= low:
        return 0.0
    if stat >= high:
        return 1.0
    return cdf.norm_cdf(_poly(UNIT_ROOT_LOW if stat <= middle else UNIT_ROOT_HIGH, stat))
