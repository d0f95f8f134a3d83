"""One-hidden-layer network on lag vectors (FCT-15).

Every (series, input size) is its own ``applyInPandas`` group, so the 30-point
default grid trains in parallel across the cluster at five copies of the rows.
Inside a group, for each hidden size: min-max scaling on the train part, lag
vectors (WIN-7), tanh hidden layer + linear output, Adam on mini-batches with
a seeded shuffle, one-step predictions on the test part, MAPE.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, as_list as _as_list, present, qcol, require_columns

INPUT_SIZES = [2, 3, 4, 5, 6]
HIDDEN_SIZES = [2, 4, 6, 8, 10, 12]


def train_net(X, y, hidden, epochs, batch, lr, seed):
    rng = np.random.default_rng(seed)
    n_in = X.shape[1]
    W1 = rng.normal(0, np.sqrt(1.0 / n_in), (n_in, hidden))
    b1 = np.zeros(hidden)
    W2 = rng.normal(0, np.sqrt(1.0 / hidden), (hidden, 1))
    b2 = np.zeros(1)
    params = [W1, b1, W2, b2]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(X))
        for s in range(0, len(X), batch):
            idx = order[s:s + batch]
            xb, yb = X[idx], y[idx, None]
            h = np.tanh(xb @ W1 + b1)
            out = h @ W2 + b2
            g_out = 2 * (out - yb) / len(idx)
            gW2 = h.T @ g_out
            gb2 = g_out.sum(0)
            gh = g_out @ W2.T * (1 - h ** 2)
            gW1 = xb.T @ gh
            gb1 = gh.sum(0)
            step += 1
            for i, g in enumerate((gW1, gb1, gW2, gb2)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                mh = m[i] / (1 - 0.9 ** step)
                vh = v[i] / (1 - 0.999 ** step)
                params[i] -= lr * mh / (np.sqrt(vh) + 1e-7)
    return params


def predict_net(params, X):
    W1, b1, W2, b2 = params
    return (np.tanh(X @ W1 + b1) @ W2 + b2)[:, 0]


NET_SCHEMA = ("input_size int, hidden_size int, mape double, mae double, rmse double, n_test long, "
              "actual array<double>, predicted array<double>, future array<double>")


def net_group(pdf, input_size, hidden, test_size, epochs, batch, lr, seed, extra_periods=0):
    pdf = pdf.sort_values("time")
    y = pdf["value"].to_numpy(dtype=float)
    n_train = int(len(y) * (1 - test_size))
    if n_train < 1:
        return pd.DataFrame([], columns=[c.split()[0] for c in NET_SCHEMA.split(", ")])
    lo, hi = y[:n_train].min(), y[:n_train].max()
    rng = hi - lo if hi > lo else 1.0
    s = (y - lo) / rng
    X = np.array([s[t - input_size:t] for t in range(input_size, len(s))])
    target = s[input_size:]
    pos = np.arange(input_size, len(s))
    tr = pos < n_train
    if tr.sum() < 2 or (~tr).sum() < 1:
        return pd.DataFrame([], columns=[c.split()[0] for c in NET_SCHEMA.split(", ")])
    params = train_net(X[tr], target[tr], hidden, epochs, batch, lr, seed)
    pred = predict_net(params, X[~tr]) * rng + lo
    actual = y[pos[~tr]]
    nz = actual != 0
    mape = float(np.mean(np.abs((pred[nz] - actual[nz]) / actual[nz]))) if nz.any() else float("nan")
    ahead = list(s[-input_size:])
    for _ in range(extra_periods):  # each future value is an input of the next
        ahead.append(float(predict_net(params, np.array([ahead[-input_size:]]))[0]))
    return pd.DataFrame([{"actual": list(actual), "predicted": list(pred),
                          "future": [x * rng + lo for x in ahead[input_size:]], "input_size": input_size, "hidden_size": hidden, "mape": mape,
                          "mae": float(np.mean(np.abs(pred - actual))),
                          "rmse": float(np.sqrt(np.mean((pred - actual) ** 2))), "n_test": int(len(actual))}])


def lag_network(df: DataFrame, target: str, time_column: str = "time", series_keys=(),
                input_sizes=None, hidden_sizes=None, epochs: int = 100, batch_size: int = 16,
                learning_rate: float = 0.001, test_size: float = 0.2, seed: int = 42,
                extra_periods: int = 0) -> DataFrame:
    """FCT-15: test metrics and forecasts per (series, input, hidden) with ``best``
    per series. Missing values are left out; series too short for an input size
    have no row for it."""
    keys = _as_list(series_keys)
    if not keys:
        raise OperatorError("lag_network needs series_keys: a table of one series is one task")
    require_columns(df, keys + [target, time_column])
    ins = list(input_sizes or INPUT_SIZES)
    hid = list(hidden_sizes or HIDDEN_SIZES)
    base = df.select(*[qcol(k) for k in keys], qcol(time_column).alias("time"),
                     present(df, target).cast("double").alias("value"),
                     F.explode(F.array(*[F.lit(i) for i in ins])).alias("input_size")).filter(F.col("value").isNotNull())
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)

    def fn(key, pdf):
        out = pd.concat([net_group(pdf, int(key[-1]), h, test_size, epochs, batch_size, learning_rate, seed, extra_periods)
                         for h in hid], ignore_index=True)
        for j, k in enumerate(keys):
            out.insert(j, k, key[j])
        return out

    res = base.groupBy(*[qcol(k) for k in keys], "input_size").applyInPandas(fn, f"{key_schema}, {NET_SCHEMA}")
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(F.col("mape").asc_nulls_last(),
                                                             "input_size", "hidden_size")
    return res.withColumn("best", F.row_number().over(w) == 1)
