"""Intermittent-demand forecasting: Croston, SBA, TSB (FCT-7..10).

Rows are dealt to tasks by series and sorted by time, a task reads them in runs of
about ``ROWS_PER_GROUP`` rows (whole series) and searches a run in numpy, vectorised
over series x candidates, a bounded chunk of series of similar length at a time. A
search keeps one size state per alpha for the three methods, TSB's chances per beta,
and meets both only in periods with demand. The forecast for a period uses the state before that period's
demand is seen; in-sample MAPE (a fraction) counts only periods with non-zero
demand; future periods use the state after the last observation (flat).

Missing demand (NULL or NaN) is left out of its series; a NULL series key is a
series of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, as_list, present, qcol, require_columns
from tabloom.operators.forecast.smoothing import GRID

METHODS = ("croston", "sba", "tsb")
ROWS_PER_GROUP = 1_000_000
# Cells (series x periods x candidates) worked on at once: bounds a task's memory.
CHUNK_CELLS = 4_000_000


def croston_batch(D: np.ndarray, method: str, alpha: np.ndarray, beta: np.ndarray,
                  paths: bool = False):
    """Run one method for S series (rows of D, NaN-padded at the end) and C
    candidates at once. Returns (mape (S, C), next forecast (S, C), and with
    ``paths`` the in-sample one-step forecasts (S, T, C), else None)."""
    S, T = D.shape
    C = alpha.shape[-1]
    valid = ~np.isnan(D)
    pos = np.where(valid & (D > 0), np.arange(T)[None, :], T)
    i0 = pos.min(axis=1)                                     # first positive demand
    has = i0 < T
    a0 = np.where(has, D[np.arange(S), np.minimum(i0, T - 1)], np.nan)
    al, be = np.atleast_2d(alpha), np.atleast_2d(beta)  # one row for all series, or one each
    a = np.repeat(a0[:, None], C, axis=1)
    if method == "tsb":
        p = np.repeat((1.0 / (1 + i0))[:, None], C, axis=1).astype(float)
        f = a * p
    else:
        p = np.repeat((1.0 + i0)[:, None], C, axis=1).astype(float)
        f = a / p
    q = np.ones((S, C))
    se = np.zeros((S, C))
    nz = np.zeros((S, 1))
    path = np.full((S, T, C), np.nan) if paths else None
    for t in range(T):
        if paths:
            path[:, t] = np.where(valid[:, t][:, None], f, np.nan)
        d = D[:, t][:, None]
        ok = valid[:, t][:, None]
        dem = ok & (d > 0)
        cnt = ok & (d != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            se += np.where(cnt, np.abs((f - d) / np.where(cnt, d, 1.0)), 0.0)
        nz += cnt
        a_new = np.where(dem, al * d + (1 - al) * a, a)
        if method == "tsb":
            p = np.where(dem, be + (1 - be) * p, np.where(ok, (1 - be) * p, p))
            a = a_new
            f = np.where(ok, p * a, f)
        else:
            p = np.where(dem, al * q + (1 - al) * p, p)
            q = np.where(dem, 1.0, np.where(ok, q + 1, q))
            a = a_new
            ratio = a / p * ((1 - al / 2) if method == "sba" else 1.0)
            f = np.where(dem, ratio, f)
    with np.errstate(divide="ignore", invalid="ignore"):
        mape = np.where(nz > 0, se / nz, np.nan)
    mape[~has] = np.nan
    return mape, f, path


def search_batch(D: np.ndarray, methods, alphas: np.ndarray, betas: np.ndarray) -> dict:
    """``croston_batch`` of every candidate: {method: (mape (S, C), next forecast (S, C))},
    TSB's candidates by alpha, then beta. The same operations in the same order: sizes
    depend on alpha only, TSB's chances on beta only, and Croston and SBA share both states."""
    S, T = D.shape
    al, be = np.asarray(alphas, dtype=float)[None, :], np.asarray(betas, dtype=float)[None, :]
    valid = ~np.isnan(D)
    pos = np.where(valid & (D > 0), np.arange(T)[None, :], T)
    i0 = pos.min(axis=1)
    has = i0 < T
    a0 = np.where(has, D[np.arange(S), np.minimum(i0, T - 1)], np.nan)
    a = np.repeat(a0[:, None], al.shape[1], axis=1)
    p = np.repeat((1.0 + i0)[:, None], al.shape[1], axis=1).astype(float)
    f = {m: a / p for m in methods if m != "tsb"}
    q = np.ones(S)
    chance = np.repeat((1.0 / (1 + i0))[:, None], be.shape[1], axis=1)
    se = {m: np.zeros((S, al.shape[1], be.shape[1]) if m == "tsb" else (S, al.shape[1])) for m in methods}
    nz = (valid & (D != 0)).sum(axis=1)[:, None].astype(float)
    for t in range(T):
        d, ok = D[:, t], valid[:, t]
        seen = np.flatnonzero(ok & (d != 0))
        x = d[seen][:, None]
        for m, v in f.items():
            se[m][seen] += np.abs((v[seen] - x) / x)
        if "tsb" in se:
            e = chance[seen][:, None, :] * a[seen][:, :, None]
            x = x[:, :, None]
            e -= x
            e /= x
            se["tsb"][seen] += np.abs(e, out=e)
        now = np.flatnonzero(ok & (d > 0))
        x = d[now][:, None]
        a[now] = new = al * x + (1 - al) * a[now]
        if f:
            p[now] = wait = al * q[now][:, None] + (1 - al) * p[now]
            q[ok] += 1
            q[now] = 1.0
            for m, v in f.items():
                v[now] = new / wait * ((1 - al / 2) if m == "sba" else 1.0)
        chance[ok] *= 1 - be
        chance[now] += be
    found = {}
    for m in methods:
        with np.errstate(divide="ignore", invalid="ignore"):
            mape = np.where(nz > 0, se[m].reshape(S, -1) / nz, np.nan)
        mape[~has] = np.nan
        found[m] = mape, f[m] if m in f else (chance[:, None, :] * a[:, :, None]).reshape(S, -1)
    return found


def _series_matrices(table: pa.Table, n_candidates: int):
    """Split rows (whole series, sorted by time, numbered from 1) into matrices of
    bounded size: yields (first row of each series, matrix padded with NaN)."""
    value = table.column("value").to_numpy()
    starts = np.flatnonzero(table.column("__tb_at").to_numpy() == 1)
    lens = np.diff(np.r_[starts, len(value)])
    order = np.argsort(lens, kind="stable")  # similar lengths together: little padding
    at = 0
    while at < len(order):
        longest = lens[order[at:]]
        cells = longest * np.arange(1, len(longest) + 1) * n_candidates
        n = max(1, int(np.searchsorted(cells, CHUNK_CELLS, side="right")))
        pick = order[at:at + n]
        D = np.full((n, lens[pick].max()), np.nan)
        for row, k in enumerate(pick):
            D[row, :lens[k]] = value[starts[k]:starts[k] + lens[k]]
        yield starts[pick], D
        at += n


def _by_group(df: DataFrame, target: str, time_column: str, keys, groups: int | None, n_candidates: int, search, schema: str):
    """Run ``search(D) -> (row of D, columns)`` on every series; keys are taken
    from the rows as they are, so NULL keys and their types stay."""
    base = df.select(*[qcol(k) for k in keys], qcol(time_column).alias("__tb_time"), present(df, target).cast("double").alias("value")) \
        .filter(F.col("value").isNotNull())
    if groups is not None:
        base = base.repartition(groups, *[qcol(k) for k in keys])
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)
    names, most = [*keys, *[c.split()[0] for c in schema.split(", ")]], ROWS_PER_GROUP

    def searched(table: pa.Table):
        for first, D in _series_matrices(table, n_candidates):
            rows, columns = search(D)
            own = table.select(keys).take(pa.array(first[rows]))
            yield from pa.table([*own.columns, *columns], names=names).combine_chunks().to_batches()

    def run(batches):
        held, size, limit = [], 0, most
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(table.column("__tb_at").to_numpy() == 1)
            yield from searched(table.slice(0, starts[-1]))  # the last series may go on
            held = table.slice(starts[-1]).to_batches()
            size -= int(starts[-1])
            limit = max(most, 2 * size)
        if size:
            yield from searched(pa.Table.from_batches(held).combine_chunks())

    # the window deals series to tasks and sorts them; rows that already lie by series are not dealt again
    order = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(F.col("__tb_time").asc_nulls_last())
    rows = base.withColumn("__tb_at", F.row_number().over(order)).drop("__tb_time")
    return rows.mapInArrow(run, f"{key_schema}, {schema}")


def _doubles(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=float), from_pandas=True)


def _lists(values: pa.Array, lengths) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)


ONE_SCHEMA = ("method string, alpha double, beta double, mape double, forecast double, "
              "nonzero_periods bigint, zero_pct double")


def croston(df: DataFrame, target: str, time_column: str = "time", series_keys=(),
            method: str = "croston", alpha: float = 0.1, beta: float = 0.1, groups: int | None = None) -> DataFrame:
    """FCT-7/8/9 for one parameter: per series in-sample MAPE on non-zero
    periods, next-period forecast, zero share. All-zero series give NULLs."""
    if method not in METHODS:
        raise OperatorError(f"unknown method {method!r}")
    keys = as_list(series_keys)
    if not keys:
        raise OperatorError("croston needs series_keys")
    require_columns(df, keys + [target, time_column])

    def search(D):
        mape, fc, _ = croston_batch(D, method, np.array([float(alpha)]), np.array([float(beta)]))
        valid, n = ~np.isnan(D), len(D)
        has = ~np.isnan(mape[:, 0])
        return np.arange(n), [
            pa.array([method] * n), _doubles(np.full(n, alpha)), _doubles(np.full(n, beta if method == "tsb" else np.nan)),
            _doubles(mape[:, 0]), _doubles(np.where(has, fc[:, 0], np.nan)), pa.array((valid & (D != 0)).sum(axis=1)),
            _doubles((valid & (D == 0)).sum(axis=1) / valid.sum(axis=1) * 100)]

    return _by_group(df, target, time_column, keys, groups, 1, search, ONE_SCHEMA)


SEARCH_SCHEMA = ("method string, alpha double, beta double, mape double, forecast double, zero_pct double, "
                 "is_best boolean, warning string, actual array<double>, predicted array<double>, future array<double>")

#: Warnings of the search.
NO_ZEROS = "no zero periods: intermittent methods may not suit this series"
MANY_ZEROS = "more than 80% zero periods: forecasts are unreliable"
ALL_ZERO = "no demand at all: nothing to forecast"


def _search(methods, alphas, betas, extra_periods: int):
    def candidates(m):
        if m == "tsb":
            return [x.ravel() for x in np.meshgrid(alphas, betas, indexing="ij")]
        return [np.asarray(alphas, dtype=float), np.full(len(alphas), np.nan)]

    def search(D):
        n, valid = len(D), ~np.isnan(D)
        zero = (valid & (D == 0)).sum(1) / valid.sum(1) * 100
        warn = np.where(zero == 100, ALL_ZERO, np.where(zero == 0, NO_ZEROS, np.where(zero > 80, MANY_ZEROS, None)))
        found = []
        tried = search_batch(D, methods, alphas, betas)
        for m in methods:
            A, B = candidates(m)
            mape, fc = tried[m]
            k = np.where(np.isnan(mape), np.inf, mape).argmin(axis=1)
            at = np.arange(n)
            path = croston_batch(D, m, A[k][:, None], B[k][:, None], True)[2][:, :, 0]
            none = np.isnan(mape[at, k])
            found.append((m, np.where(none, np.nan, A[k]), np.where(none, np.nan, B[k]), mape[at, k],
                          np.where(none, np.nan, fc[at, k]), path))
        score = np.stack([np.where(np.isnan(f[3]), np.inf, f[3]) for f in found])
        best = np.where(np.isinf(score.min(axis=0)), -1, score.argmin(axis=0))
        rows = np.tile(np.arange(n), len(found))
        cut = valid.sum(1)  # missing demand is left out before, NaN only fills up
        actual = _doubles(D[valid])
        predicted = _doubles(np.concatenate([f[5][valid] for f in found]))
        last = np.concatenate([f[4] for f in found])
        ahead = np.where(np.isnan(last), 0, extra_periods)
        return rows, [
            pa.array(np.repeat([f[0] for f in found], n)), _doubles(np.concatenate([f[1] for f in found])),
            _doubles(np.concatenate([f[2] if f[0] == "tsb" else np.full(n, np.nan) for f in found])),
            _doubles(np.concatenate([f[3] for f in found])), _doubles(last),
            _doubles(np.tile(zero, len(found))), pa.array(np.concatenate([best == j for j in range(len(found))])),
            pa.array(list(warn) * len(found), pa.string()),
            _lists(pa.concat_arrays([actual] * len(found)), np.tile(cut, len(found))),
            _lists(predicted, np.tile(cut, len(found))), _lists(_doubles(np.repeat(last, ahead)), ahead)]

    return search


def croston_search(df: DataFrame, target: str, time_column: str = "time", series_keys=(), methods=METHODS,
                   alphas=None, betas=None, extra_periods: int = 0, groups: int | None = None) -> DataFrame:
    """FCT-10: best parameter per method and best method per series, with the
    actual values, the in-sample forecasts and ``extra_periods`` future ones.

    All-zero series stay, with NULL scores and a warning.
    """
    keys = as_list(series_keys)
    if not keys:
        raise OperatorError("croston_search needs series_keys")
    require_columns(df, keys + [target, time_column])
    a = np.array(alphas or GRID, dtype=float)
    b = np.array(betas or GRID, dtype=float)
    width = max(len(a) * (len(b) if "tsb" in methods else 1), 1)
    return _by_group(df, target, time_column, keys, groups, width, _search(tuple(methods), a, b, extra_periods), SEARCH_SCHEMA)
