"""Linear fits and their scores from first and second moments (ML-18..23 on large tables).

A least squares fit, with or without a penalty, reads a table only through the means and
covariances of features and target, and so do R² and squared errors. One pass leaves
them per fold; folds merge exactly. Spark's own ``LinearRegression`` is then fitted on
two weighted rows per column that have these very moments.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import qcol


def by_group(df: DataFrame, features, target: str, groups) -> dict | None:
    """(rows, means, covariances) by group, rows with a missing feature left out; None
    when a label is missing or a value has no finite square."""
    cols = [*features, target]
    rows = df.select(*groups, *[qcol(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]) \
        .na.drop(subset=[f"v{i}" for i in range(len(features))])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    y = F.col(f"v{len(features)}")
    found = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("bad"),
        *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(cols))],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in found:
        mean, cov = np.array([r[f"m{i}"] for i in range(len(cols))], float), np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = np.nan if r[f"c{i}_{j}"] is None else r[f"c{i}_{j}"]
        if r.bad or not (np.isfinite(mean).all() and np.isfinite(cov).all()):
            return None
        out[tuple(r[g] for g in groups)] = (float(r.n), mean, cov)
    return out or None


def merge(parts: list) -> tuple:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n


def fit(spark, pipe, features, target: str, m: tuple):
    """(coefficients, intercept) of the pipeline's linear model on rows with moments ``m``."""
    n, mean, cov = m
    unit = np.sqrt(np.diag(cov))
    safe = np.where(unit > 0, unit, 1.0)
    size, turn = np.linalg.eigh(cov / np.outer(safe, safe))
    steps = (turn * np.sqrt(np.maximum(size, 0.0))).T * unit * math.sqrt(len(mean))
    rows = [tuple(map(float, (*(mean + s * v), n / (2 * len(mean))))) for v in steps for s in (1, -1)]
    table = spark.createDataFrame(rows, [*features, target, "__tb_w"]).coalesce(1)
    pipe.getStages()[-1].setWeightCol("__tb_w")
    model = pipe.fit(table).stages[-1]
    return model.coefficients.toArray(), model.intercept


def score(model: tuple, m: tuple, metric: str) -> float:
    """R², or minus the (root) mean squared error, on rows with moments ``m``."""
    w, b = model
    _, mean, cov = m
    turn = np.r_[-w, 1.0]
    mse = max(float(turn @ cov @ turn + (turn @ mean - b) ** 2), 0.0)
    if metric == "r2":
        return 1 - mse / float(cov[-1, -1]) if cov[-1, -1] else 0.0
    return -mse if metric == "mse" else -math.sqrt(mse)
