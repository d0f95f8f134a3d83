"""Exponential smoothing (FCT-3..6).

* Single smoothing is a fold: each (series, alpha) candidate folds its sorted
  train values with ``F.aggregate`` inside the JVM; candidates are rows
  (``explode`` of the alpha grid), so the grid runs in parallel.
* Double/triple smoothing run in ``applyInPandas`` per series, with the whole
  candidate grid vectorised in numpy (loop over time only).

Tables without series keys, and tables with a series of more than
``LONG_SERIES`` periods, are run by the block scan of
:mod:`tabloom.operators.forecast.affine` (``plan="blocks"``), which gives the
same candidates, scores and forecasts without a task per series.

Initial states, ``initial="fixed"``: level = first value (single); level = y0
and trend = y1 - y0 (double); first-season means (triple). With
``initial="estimated"`` the start state of each candidate has the least squared
one-step error on the part that it is fitted to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import (OperatorError, as_list as _as_list, null_safe_join, present, qcol,
                                           require_columns)
from tabloom.operators.forecast import affine
from tabloom.operators.forecast.metrics import metric_exprs
from tabloom.operators.windows import series_positions
from tabloom.session import cut_lineage

GRID = [round(0.1 * i, 1) for i in range(1, 10)]
SEASONS = [2, 3, 4, 5, 6]
LONG_SERIES = 200_000


def _plan(df: DataFrame, keys, plan: str) -> str:
    """``plan``, or for ``"auto"`` the plan that fits the longest series."""
    if plan not in ("auto", "series", "blocks"):
        raise OperatorError("plan must be 'auto', 'series' or 'blocks'")
    if plan == "series" and not keys:
        raise OperatorError("plan 'series' needs series_keys: a table of one series would be one task")
    if plan != "auto":
        return plan
    if not keys:
        return "blocks"
    longest = df.groupBy(*[qcol(k) for k in keys]).count().agg(F.max("count")).head()[0]
    return "blocks" if (longest or 0) > LONG_SERIES else "series"


def _key_columns(keys) -> list:
    return [F.col("key").getField(k).alias(k) for k in keys]


def split_flags(df: DataFrame, target: str, time_column: str, keys, test_size: float,
                validation_size: float = 0.0) -> DataFrame:
    """Row position, test flag and validation flag per series (chronological)."""
    df = df.filter(present(df, target).isNotNull())
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(qcol(time_column))
    n = F.count(F.lit(1)).over(Window.partitionBy(*[qcol(k) for k in keys]))
    n_train = F.floor(n * F.lit(1.0 - test_size))
    out = df.select(*[qcol(k) for k in keys], qcol(time_column).alias("time"),
                    qcol(target).cast("double").alias("value"), F.row_number().over(w).alias("pos"),
                    n_train.alias("n_train"))
    n_fit = F.floor(F.col("n_train") * F.lit(1.0 - validation_size))
    return out.withColumn("is_test", F.col("pos") > F.col("n_train")) \
        .withColumn("is_valid", (F.col("pos") > n_fit) & ~F.col("is_test"))


def ses_search(df: DataFrame, target: str, time_column: str = "time", series_keys=(),
               alphas=None, test_size: float = 0.2, select_on: str = "validation",
               validation_size: float = 0.2, initial: str = "fixed", plan: str = "auto",
               block: int = affine.BLOCK) -> DataFrame:
    """FCT-3: single exponential smoothing over an alpha grid; flat forecast.

    ``select_on="test"`` reproduces the reference (chooses alpha on the test
    part); the default chooses on the last ``validation_size`` of the train
    part and then refits on the whole train part. Returns one row per series
    and alpha with test metrics and ``best`` marking the chosen alpha.
    """
    keys = _as_list(series_keys)
    require_columns(df, keys + [target, time_column])
    grid = list(alphas) if alphas else GRID
    if select_on not in ("test", "validation"):
        raise OperatorError("select_on must be 'test' or 'validation'")
    if initial not in ("fixed", "estimated"):
        raise OperatorError("initial must be 'fixed' or 'estimated'")
    if _plan(df, keys, plan) == "blocks":
        grid_plan = affine.chunks(["single"], grid, [], [], [])
        found, _ = affine.candidate_scores(df, target, time_column, keys, grid_plan, test_size, select_on, validation_size, initial, block)
        return found.select(*_key_columns(keys), "alpha", "mape", "mae", "mse", "rmse", "r2", F.col("n_test").alias("n"),
                            F.get("state", F.lit(0)).alias("level"), (F.col("rank") == 1).alias("best"))
    flagged = split_flags(df, target, time_column, keys, test_size,
                          validation_size if select_on == "validation" else 0.0)
    pt = F.struct(F.col("time").alias("t"), F.col("value").alias("v"))
    series = flagged.groupBy(*[qcol(k) for k in keys]).agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_test"), pt))).alias("_train"),
        F.sort_array(F.collect_list(F.when(~F.col("is_test") & ~F.col("is_valid"), pt))).alias("_fit"))
    cand = series.select("*", F.explode(F.array(*[F.lit(float(a)) for a in grid])).alias("alpha"))

    def fold(arr):
        return F.aggregate(F.slice(arr, 2, 1 << 30), F.try_element_at(arr, F.lit(1))["v"],
                           lambda acc, x: acc * (1 - F.col("alpha")) + x["v"] * F.col("alpha"))

    def fitted(arr):
        """The level from zero (s), the weight of the start (r) and the sums that give
        the start with the least squared error (g / w)."""
        def step(acc, x):
            e = x["v"] - acc["s"]
            return F.struct((acc["s"] + F.col("alpha") * e).alias("s"), (acc["r"] * (1 - F.col("alpha"))).alias("r"),
                            (acc["g"] + acc["r"] * e).alias("g"), (acc["w"] + acc["r"] * acc["r"]).alias("w"))
        begin = F.struct(*[F.lit(v).alias(c) for c, v in (("s", 0.0), ("r", 1.0), ("g", 0.0), ("w", 0.0))])
        return F.aggregate(arr, begin, step, lambda acc: F.when(acc["w"] > 0, acc["s"] + acc["r"] * acc["g"] / acc["w"]))

    level = fold if initial == "fixed" else fitted
    cand = cand.select(*[qcol(k) for k in keys], "alpha", level(F.col("_train")).alias("level"),
                       level(F.col("_fit")).alias("fit_level"))
    scored = null_safe_join(flagged, cand, keys, "inner")
    a = F.col("value")
    test = scored.filter("is_test").groupBy(*[qcol(k) for k in keys], "alpha").agg(
        *metric_exprs(a, F.col("level"), zero="skip"), F.first("level").alias("level"))
    if select_on == "test":
        sel = test.select(*keys, "alpha", F.col("mape").alias("_sel"))
    else:
        sel = scored.filter("is_valid").groupBy(*[qcol(k) for k in keys], "alpha").agg(
            F.avg(F.when(a != 0, F.abs((F.col("fit_level") - a) / a))).alias("_sel"))
    out = null_safe_join(test, sel, keys + ["alpha"], "left")
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(F.round("_sel", 12).asc_nulls_last(), "alpha")
    return out.withColumn("best", F.row_number().over(w) == 1).drop("_sel")


# --------------------------------------------------------------------------
# Double / triple smoothing (numpy, vectorised over candidates)
# --------------------------------------------------------------------------


def holt_paths(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, steps: int) -> np.ndarray:
    """Additive-trend smoothing for C candidates -> (C, steps) forecasts."""
    level = np.full(alpha.shape, y[0], dtype=float)
    trend = np.full(alpha.shape, y[1] - y[0] if len(y) > 1 else 0.0, dtype=float)
    for t in range(1, len(y)):
        prev = level
        level = alpha * y[t] + (1 - alpha) * (level + trend)
        trend = beta * (level - prev) + (1 - beta) * trend
    h = np.arange(1, steps + 1, dtype=float)
    return level[:, None] + trend[:, None] * h[None, :]


def holt_winters_paths(y: np.ndarray, alpha, beta, gamma, m: int, steps: int) -> np.ndarray:
    """Additive trend + additive season of period m for C candidates."""
    if len(y) < 2 * m:
        raise ValueError("series shorter than two seasons")
    c = alpha.shape[0]
    l0 = y[:m].mean()
    b0 = (y[m:2 * m].mean() - y[:m].mean()) / m
    season = np.tile(y[:m] - l0, (c, 1))
    level = np.full(c, l0)
    trend = np.full(c, b0)
    for t in range(m, len(y)):
        s = season[:, t % m]
        prev = level
        level = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - prev) + (1 - beta) * trend
        season[:, t % m] = gamma * (y[t] - level) + (1 - gamma) * s
    n = len(y)
    h = np.arange(1, steps + 1)
    idx = (n + h - 1) % m
    return level[:, None] + trend[:, None] * h[None, :] + season[:, idx]


def _mape_skip(pred: np.ndarray, actual: np.ndarray) -> np.ndarray:
    nz = actual != 0
    if not nz.any():
        return np.full(pred.shape[0], np.nan)
    return np.mean(np.abs((pred[:, nz] - actual[nz]) / actual[nz]), axis=1)


def _metrics(pred: np.ndarray, actual: np.ndarray) -> dict:
    err = pred - actual
    mse = float(np.mean(err ** 2))
    ss_tot = float(np.sum((actual - actual.mean()) ** 2))
    return {"mae": float(np.mean(np.abs(err))), "mse": mse, "rmse": float(np.sqrt(mse)),
            "r2": 0.0 if ss_tot == 0 else float(1 - np.sum(err ** 2) / ss_tot)}


SMOOTHING_SCHEMA = ("method string, alpha double, beta double, gamma double, season_period int, "
                    "mape double, mae double, mse double, rmse double, r2 double, n_test long, "
                    "candidates long, failures long, warning string, actual array<double>, predicted array<double>, "
                    "future array<double>")


def smoothing_group(pdf: pd.DataFrame, methods, alphas, betas, gammas, seasons, test_size,
                    select_on: str = "test", validation_size: float = 0.2, extra_periods: int = 0,
                    initial: str = "fixed") -> pd.DataFrame:
    """Best double and triple candidates for one series (pandas in, pandas out);
    a method that the series is too short for gives a row with the reason."""
    if initial == "fixed":
        holt, winters = holt_paths, holt_winters_paths
    else:
        def estimated(method, m, y, alpha, beta, gamma, steps):
            k = affine.Chunk(method, m, alpha, beta, gamma, 0)
            if len(y) < k.need:
                raise ValueError("series too short")
            return affine.forecast(k, affine.smoothed_states(k, y, "estimated"), np.arange(1, steps + 1))

        def holt(y, a, b, steps):
            return estimated("double", 0, y, a, b, np.zeros_like(a), steps)

        def winters(y, a, b, g, m, steps):
            return estimated("triple", m, y, a, b, g, steps)
    pdf = pdf.sort_values("time")
    y = pdf["value"].to_numpy(dtype=float)
    n_train = int(np.floor(len(y) * (1 - test_size)))
    train, test = y[:n_train], y[n_train:]
    if select_on == "validation":
        n_fit = int(np.floor(n_train * (1 - validation_size)))
        fit, sel = train[:n_fit], train[n_fit:]
    else:
        fit, sel = train, test
    rows = []
    if "double" in methods and len(train) >= 2 and len(test) > 0:
        A, B = np.meshgrid(alphas, betas, indexing="ij")
        A, B = A.ravel(), B.ravel()
        score = _mape_skip(holt(fit, A, B, len(sel)), sel) if len(fit) >= 2 and len(sel) else None
        k = int(np.nanargmin(np.round(score, 12))) if score is not None and np.isfinite(score).any() else 0
        pred = holt(train, A[k:k + 1], B[k:k + 1], len(test))[0]
        rows.append({"method": "double", "alpha": A[k], "beta": B[k], "gamma": None, "season_period": None,
                     "mape": float(_mape_skip(pred[None, :], test)[0]), **_metrics(pred, test),
                     "n_test": len(test), "candidates": len(A), "failures": 0, "actual": list(test),
                     "predicted": list(pred),
                     "future": list(holt(y, A[k:k + 1], B[k:k + 1], extra_periods)[0]) if extra_periods else []})
    elif "double" in methods:
        rows.append({"method": "double", "n_test": len(test), "warning": "series too short for double smoothing"})
    if "triple" in methods and len(test) > 0:
        best, fails, total = None, 0, 0
        for m in seasons:
            A, B, G = (x.ravel() for x in np.meshgrid(alphas, betas, gammas, indexing="ij"))
            total += len(A)
            try:
                score = _mape_skip(winters(fit, A, B, G, m, len(sel)), sel)
            except ValueError:
                fails += len(A)
                continue
            if not np.isfinite(score).any():
                continue
            score = np.round(score, 12)  # equal but for rounding: the first one
            k = int(np.nanargmin(score))
            if best is None or score[k] < best[0]:
                best = (score[k], A[k], B[k], G[k], m)
        if best is not None:
            _, a, b, g, m = best
            one = np.array([a]), np.array([b]), np.array([g])
            pred = winters(train, *one, m, len(test))[0]
            rows.append({"actual": list(test), "predicted": list(pred),
                         "future": list(winters(y, *one, m, extra_periods)[0]) if extra_periods else [],
                         "method": "triple", "alpha": a, "beta": b, "gamma": g, "season_period": m,
                         "mape": float(_mape_skip(pred[None, :], test)[0]), **_metrics(pred, test),
                         "n_test": len(test), "candidates": total, "failures": fails})
        else:
            rows.append({"method": "triple", "n_test": len(test), "candidates": total, "failures": fails,
                         "warning": "series too short for triple smoothing, or no test period with demand"})
    elif "triple" in methods:
        rows.append({"method": "triple", "n_test": len(test), "warning": "series too short for triple smoothing"})
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SMOOTHING_SCHEMA.split(", ")])
    return without_nan(out)


def without_nan(out: pd.DataFrame) -> pd.DataFrame:
    """Missing cells as None, also in columns of lists and texts."""
    out = out.astype(object)
    return out.where(out.notna(), None)


def smoothing_search(df: DataFrame, target: str, time_column: str = "time", series_keys=(),
                     methods=("double", "triple"), alphas=None, betas=None, gammas=None,
                     seasons=None, test_size: float = 0.2, select_on: str = "test",
                     extra_periods: int = 0, initial: str = "fixed", plan: str = "auto",
                     block: int = affine.BLOCK, validation_size: float = 0.2) -> DataFrame:
    """FCT-4/5: double and triple smoothing grids, one pandas group per series,
    with the actual and predicted test values and ``extra_periods`` future ones.

    The block plan leaves ``actual`` and ``predicted`` NULL (a long series' test
    part is no cell); :func:`long_forecasts` gives them as rows.
    Missing values (NULL or NaN) are left out of their series."""
    keys = _as_list(series_keys)
    require_columns(df, keys + [target, time_column])
    if initial not in ("fixed", "estimated"):
        raise OperatorError("initial must be 'fixed' or 'estimated'")
    if _plan(df, keys, plan) == "blocks":
        found = _search_blocks(df, target, time_column, keys, methods, alphas, betas, gammas, seasons, test_size, select_on,
                               validation_size, initial, block, extra_periods)
        return found.select(*[qcol(k) for k in keys], *[c.split()[0] for c in SMOOTHING_SCHEMA.split(", ")])
    a = np.array(alphas or GRID, dtype=float)
    b = np.array(betas or GRID, dtype=float)
    g = np.array(gammas or GRID, dtype=float)
    ms = list(seasons or SEASONS)
    base = df.select(*[qcol(k) for k in keys], qcol(time_column).alias("time"),
                     present(df, target).cast("double").alias("value")).filter(F.col("value").isNotNull())
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)

    def fn(key, pdf):
        out = smoothing_group(pdf, methods, a, b, g, ms, test_size, select_on, validation_size, extra_periods, initial)
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    return base.groupBy(*[qcol(k) for k in keys]).applyInPandas(fn, f"{key_schema}, {SMOOTHING_SCHEMA}")


def _search_blocks(df, target, time_column, keys, methods, alphas, betas, gammas, seasons, test_size, select_on, validation_size,
                   initial, block, extra_periods) -> DataFrame:
    """The best candidate of every series and method by the block scan, with its
    states at the ends of the train part and of the series."""
    plan = affine.chunks(methods, list(alphas or GRID), list(betas or GRID), list(gammas or GRID), list(seasons or SEASONS))
    found, series = affine.candidate_scores(df, target, time_column, keys, plan, test_size, select_on, validation_size, initial, block)
    best = found.filter("rank = 1").filter((F.col("method") != "triple") | F.col("score").isNotNull())
    spark = df.sparkSession
    totals = spark.createDataFrame([(k, m, sum(len(c) for c in plan if c.method == k and c.m == m)) for k, m in
                                    dict.fromkeys((c.method, c.m) for c in plan)], "method string, m int, size long")
    fails = (F.col("method") == "triple") & (F.col("n_fit") < 2 * F.col("m"))
    tries = (series.join(F.broadcast(totals)).groupBy("key", "n", "n_train", "method")
             .agg(F.sum("size").alias("candidates"), F.sum(F.when(fails, F.col("size")).otherwise(0)).alias("failures")))
    out = tries.withColumnRenamed("key", "tk").withColumnRenamed("method", "tm").join(
        best, F.expr("tk <=> key AND tm = method"), "left")
    text = F.concat(F.lit("series too short for "), F.col("tm"), F.lit(" smoothing"),
                    F.when((F.col("tm") == "triple") & (F.col("n") > F.col("n_train")), ", or no test period with demand").otherwise(""))
    none = F.lit(None).cast("array<double>")
    steps = F.sequence(F.lit(1), F.lit(extra_periods)) if extra_periods else F.array().cast("array<int>")
    future = F.transform(steps, lambda h: affine.forecast_column(F.col("tm"), F.col("last_state"), F.col("season_period"), h))
    tried = F.when(F.col("method").isNotNull() | ((F.col("tm") == "triple") & (F.col("n") > F.col("n_train"))), F.lit(True))
    return out.select(*[F.col("tk").getField(k).alias(k) for k in keys], F.col("tm").alias("method"), "alpha", "beta", "gamma", "season_period",
                      "mape", "mae", "mse", "rmse", "r2", (F.col("n") - F.col("n_train")).alias("n_test"),
                      F.when(tried, F.col("candidates")).alias("candidates"), F.when(tried, F.col("failures")).alias("failures"),
                      F.when(F.col("method").isNull(), text).alias("warning"), none.alias("actual"), none.alias("predicted"),
                      F.when(F.col("method").isNotNull(), future).alias("future"), F.col("tk").alias("series"), "state", "n", "n_train")


def long_forecasts(df: DataFrame, target: str, time_column: str = "time", series_keys=(), methods=("single", "double", "triple"),
                   alphas=None, betas=None, gammas=None, seasons=None, test_size: float = 0.2, select_on: str = "test",
                   extra_periods: int = 0, initial: str = "fixed", block: int = affine.BLOCK, validation_size: float = 0.2) -> DataFrame:
    """Rows of FCT-3..6 for series of any length: ``keys, method, step, actual,
    predicted`` of the test part and, with NULL actuals, of the future."""
    keys = _as_list(series_keys)
    require_columns(df, keys + [target, time_column])
    found = _search_blocks(df, target, time_column, keys, methods, alphas, betas, gammas, seasons, test_size, select_on,
                           validation_size, initial, block, extra_periods).filter("state IS NOT NULL")
    found = cut_lineage(found.select("series", "method", "season_period", "state", "n", "n_train", "future"))
    key = F.struct(*[qcol(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    base = df.select(key.alias("key"), qcol(time_column).alias("time"), present(df, target).cast("double").alias("actual")).filter("actual IS NOT NULL")
    rows = series_positions(base, "time", "key", rows_per_block=max(block, 1), pos="p", size="size")
    step = F.col("p") - F.col("n_train")
    tests = (rows.join(found, F.expr("key <=> series")).filter(step > 0)
             .select("series", "method", step.alias("step"), "actual",
                     affine.forecast_column(F.col("method"), F.col("state"), F.col("season_period"), step).alias("predicted")))
    later = (found.select("series", "method", F.col("n") - F.col("n_train"), F.posexplode("future").alias("i", "predicted"))
             .toDF("series", "method", "n_test", "i", "predicted")
             .select("series", "method", (F.col("n_test") + F.col("i") + 1).alias("step"), F.lit(None).cast("double").alias("actual"), "predicted"))
    return tests.unionByName(later).select(*[F.col("series").getField(k).alias(k) for k in keys], "method", "step", "actual", "predicted")


def smoothing_forecasts(ses: DataFrame, others: DataFrame, series_keys, extra_periods: int = 0) -> DataFrame:
    """Rows of FCT-3..6: ``keys, method, step, actual, predicted`` of the test
    part and, with NULL actuals, of the future. ``ses`` comes from
    :func:`ses_search` (its best alpha), ``others`` from :func:`smoothing_search`."""
    keys = _as_list(series_keys)
    pair = F.arrays_zip(F.concat("actual", F.transform("future", lambda x: F.lit(None).cast("double"))).alias("actual"),
                        F.concat("predicted", "future").alias("predicted"))
    rest = others.filter("predicted IS NOT NULL").select(*[qcol(k) for k in keys], "method", F.posexplode(pair)) \
        .select(*[qcol(k) for k in keys], "method", (F.col("pos") + 1).cast("long").alias("step"),
                F.col("col")["actual"].alias("actual"), F.col("col")["predicted"].alias("predicted"))
    steps = F.sequence(F.lit(1).cast("long"), F.col("n") + F.lit(extra_periods))
    single = ses.filter("best").select(*[qcol(k) for k in keys], F.lit("single").alias("method"),
                                       F.col("level").alias("predicted"), F.explode(steps).alias("step")) \
        .select(*[qcol(k) for k in keys], "method", "step", F.lit(None).cast("double").alias("actual"), "predicted")
    tests = rest.filter("actual IS NOT NULL").groupBy(*[qcol(k) for k in keys], "step").agg(F.max("actual").alias("a"))
    single = null_safe_join(single, tests, [*keys, "step"], "left").withColumn("actual", F.col("a")).drop("a")
    return single.unionByName(rest)


def best_smoothing(ses: DataFrame, others: DataFrame, series_keys=()) -> DataFrame:
    """FCT-6: best of single/double/triple per series by test MAPE."""
    keys = _as_list(series_keys)
    single = ses.filter("best").select(*keys, F.lit("single").alias("method"), "alpha",
                                       "mape", "mae", "mse", "rmse", "r2")
    rest = others.filter("warning IS NULL").select(*keys, "method", "alpha", "mape", "mae", "mse", "rmse", "r2")
    allm = single.unionByName(rest)
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(F.col("mape").asc_nulls_last(), "method")
    return allm.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk") \
        .withColumn("has_seasonality", F.col("method") == "triple")
