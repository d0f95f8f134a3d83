"""Block scan of exponential smoothing against the plain recursions."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tabloom.functions.expressions import OperatorError
from tabloom.operators.forecast import affine, smoothing

A, B, G, M = [0.1, 0.4, 0.9], [0.2, 0.7], [0.3, 0.8], [2, 5]


def values(n, seed=1):
    r = random.Random(seed)
    return [50 + 0.3 * t + 8 * math.sin(t * 1.3) + r.gauss(0, 4) for t in range(n)]


def table(spark, series):
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(t), v, 0) for k, y in series.items() for t, v in enumerate(y)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "s string, day date, y double, part int")


def grid():
    return affine.chunks(["single", "double", "triple"], A, B, G, M)


@pytest.mark.parametrize("k", grid(), ids=lambda k: f"{k.method}{k.m}")
def test_maps_compose(k):
    y = np.array(values(101))
    plain = affine.smoothed_states(k, y, "fixed")
    s = affine.start_state(k, y)
    for lo, hi in ((k.skip, 30), (30, 31), (31, 101)):
        c, _ = affine.block_map(k, y[lo:hi], False)
        s = np.einsum("cij,cj->ci", affine.powers(k, hi - lo)[0], s) + c
    assert np.allclose(s, plain, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("k", grid(), ids=lambda k: f"{k.method}{k.m}")
def test_estimated_start_is_least_squares(k):
    y = np.array(values(60, 3))

    def errors(s):
        s, out = np.array(s)[None, :], []
        one = affine.Chunk(k.method, k.m, k.alpha[c:c + 1], k.beta[c:c + 1], k.gamma[c:c + 1], 0)
        for v in y:
            out.append(v - affine.forecast(one, s, np.array([1]))[0, 0])
            s = affine.advance(one, s, v)
        return np.array(out), s[0]

    ends = affine.smoothed_states(k, y, "estimated")
    for c in range(len(k)):
        zero, _ = errors(np.zeros(k.d))
        design = np.stack([zero - errors(e)[0] for e in np.eye(k.d)], axis=1)
        best = np.linalg.lstsq(design, zero, rcond=1e-6)[0]
        e, end = errors(best)
        steps = np.arange(1, 9)
        one = affine.Chunk(k.method, k.m, k.alpha[c:c + 1], k.beta[c:c + 1], k.gamma[c:c + 1], 0)
        assert np.allclose(affine.forecast(one, ends[c:c + 1], steps), affine.forecast(one, end[None, :], steps), rtol=1e-6, atol=1e-6)
        fixed = affine.start_state(one, y)[0]
        if k.skip == 1 and k.method == "single":
            assert e @ e <= errors(fixed)[0] @ errors(fixed)[0] + 1e-9


SERIES = {"a": values(90), None: values(47, 2), "c": [5.0] * 30, "short": [1.0, 2.0, 4.0], "one": [3.0], "zero": [1.0] * 12 + [0.0] * 3}
COLUMNS = ["method", "alpha", "beta", "gamma", "season_period", "mape", "mae", "mse", "rmse", "r2", "n_test", "candidates", "failures", "warning", "future"]


def same(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7)
    return a == b


@pytest.mark.parametrize("initial", ["fixed", "estimated"])
@pytest.mark.parametrize("select_on", ["test", "validation"])
def test_double_triple_both_plans(spark, initial, select_on):
    df = table(spark, {k: v for k, v in SERIES.items() if k != "c"})
    options = dict(alphas=A, betas=B, gammas=G, seasons=M, select_on=select_on, extra_periods=4, initial=initial)
    small = {(r.s, r.method): r for r in smoothing.smoothing_search(df, "y", "day", ["s"], plan="series", **options).collect()}
    large = {(r.s, r.method): r for r in smoothing.smoothing_search(df, "y", "day", ["s"], plan="blocks", block=13, **options).collect()}
    assert set(small) == set(large)
    for key, want in small.items():
        for c in COLUMNS:
            # NULL and an empty list are both "no future"
            assert same(large[key][c] or None, want[c] or None), (key, c, large[key][c], want[c])


@pytest.mark.parametrize("initial", ["fixed", "estimated"])
@pytest.mark.parametrize("select_on", ["test", "validation"])
def test_single_both_plans(spark, initial, select_on):
    df = table(spark, SERIES)
    small = {(r.s, r.alpha): r for r in smoothing.ses_search(df, "y", "day", ["s"], select_on=select_on, initial=initial, plan="series").collect()}
    large = {(r.s, r.alpha): r for r in smoothing.ses_search(df, "y", "day", ["s"], select_on=select_on, initial=initial, plan="blocks", block=7).collect()}
    small = {k: r for k, r in small.items() if r.level is not None}
    assert set(small) == set(large)
    for key, want in small.items():
        for c in ("mape", "mae", "mse", "rmse", "r2", "n", "level"):
            assert same(large[key][c], want[c]), (key, c)
        assert large[key].best == want.best or key[0] in ("c", "zero", "short"), key


def test_one_series_without_keys(spark):
    y = values(400, 5)
    df = table(spark, {"a": y}).drop("s")
    one = smoothing.smoothing_search(df, "y", "day", alphas=A, betas=B, gammas=G, seasons=M, block=50, extra_periods=3).collect()
    keyed = smoothing.smoothing_search(table(spark, {"a": y}), "y", "day", ["s"], alphas=A, betas=B, gammas=G, seasons=M, extra_periods=3).collect()
    assert sorted(r.method for r in one) == ["double", "triple"]
    for r in one:
        want = next(k for k in keyed if k.method == r.method)
        assert all(same(r[c], want[c]) for c in COLUMNS)
    rows = smoothing.long_forecasts(df, "y", "day", alphas=A, betas=B, gammas=G, seasons=M, block=50, extra_periods=3).collect()
    for want in keyed:
        got = sorted((r.step, r.actual, r.predicted) for r in rows if r.method == want.method)
        assert same([g[2] for g in got], want.predicted + want.future)
        assert same([g[1] for g in got], want.actual + [None] * 3)
    assert len(smoothing.ses_search(df, "y", "day", block=50).collect()) == 9


def test_bad_arguments(spark):
    df = table(spark, {"a": values(20)})
    for bad in (dict(plan="x"), dict(initial="x"), dict(plan="series", series_keys=())):
        with pytest.raises(OperatorError):
            smoothing.smoothing_search(df, "y", "day", **{"series_keys": ["s"], **bad})
