"""Moving-average forecasters (FCT-1, FCT-2): fixed linear filters of lags.

Input is a long table ``series_keys + time + value``. Predictions are linear
combinations of lag columns from :func:`tabloom.operators.windows.lagged_values`
(``lag`` windows on small tables, positions + shift-join on large ones), so a
long series is never held by one task; all weight candidates are scored from
the same lag columns in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import as_list as _as_list, OperatorError, qcol, require_columns
from tabloom.operators.forecast.metrics import forecast_metrics
from tabloom.operators.windows import lagged_values, series_positions

# Fixed default weight triples for window 3 (oldest -> newest).
DEFAULT_WEIGHTS = [
    [0.1, 0.3, 0.6],
    [0.2, 0.3, 0.5],
    [0.2, 0.4, 0.4],
    [0.3, 0.3, 0.4],
    [0.1, 0.4, 0.5],
    [0.1, 0.2, 0.7],
]


def _lagged_series(df: DataFrame, target_column: str, time_column: str, keys, lags, test_size: float,
                   rows_per_block: int | None = None) -> DataFrame:
    """keys, time, actual, ``_lag{i}`` for i in ``lags``, is_test.

    Lags and positions come from :mod:`tabloom.operators.windows`: windows on
    small tables, block-split positions + shift-join on large ones, so a long
    series is never one task.
    """
    base = df.select(*[qcol(k) for k in keys], qcol(time_column),
                     qcol(target_column).cast("double").alias("actual"))
    n = base.count()  # one sizing job for both steps
    lagged = lagged_values(base, "actual", lags, [time_column], keys, rows_per_block, n_rows=n)
    pos = series_positions(lagged, [time_column], keys, rows_per_block, n_rows=n)
    n_train = F.floor(F.col("_size") * F.lit(1.0 - test_size))
    return pos.withColumn("is_test", F.col("_pos") > n_train).drop("_pos", "_size")


def _mean_of_lags(size: int):
    cols = [F.col(f"_lag{i}") for i in range(1, size + 1)]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(present, reduce(lambda a, b: a + b, cols) / size)


def _weighted_lags(weights):
    k = len(weights)
    return reduce(lambda a, b: a + b, [F.lit(float(wt)) * F.col(f"_lag{k - i}") for i, wt in enumerate(weights)])


def sma_forecast(df: DataFrame, target_column: str, time_column: str = "time",
                 series_keys=(), window_size: int = 3, test_size: float = 0.2,
                 rows_per_block: int | None = None) -> DataFrame:
    """FCT-1: prediction at t = mean of the ``window_size`` values before t.

    Returns the forecast table (keys, time, actual, predicted, is_test).
    """
    keys = _as_list(series_keys)
    require_columns(df, keys + [target_column, time_column])
    window_size = max(2, int(window_size))
    t = _lagged_series(df, target_column, time_column, keys, range(1, window_size + 1), test_size,
                       rows_per_block)
    return t.select(*[qcol(k) for k in keys], qcol(time_column), "actual",
                    _mean_of_lags(window_size).alias("predicted"), "is_test")


def sma_metrics(df: DataFrame, target_column: str, time_column: str = "time",
                series_keys=(), window_size: int = 3, test_size: float = 0.2) -> DataFrame:
    """FCT-1 metrics over the whole series (as the reference scores it)."""
    keys = _as_list(series_keys)
    fc = sma_forecast(df, target_column, time_column, keys, window_size, test_size)
    return forecast_metrics(fc, by=keys)


def wma_search(df: DataFrame, target_column: str, time_column: str = "time",
               series_keys=(), window_size: int = 3, weight_combinations=None) -> DataFrame:
    """FCT-2: score each weight vector by one-step MAPE; best per series.

    All candidate predictions come from the same lag columns (one column per
    candidate), are stacked, scored by one ``groupBy`` and ranked per series.
    Returns keys, candidate, weights, mape, mae, mse, rmse, r2, n.
    """
    keys = _as_list(series_keys)
    require_columns(df, keys + [target_column, time_column])
    combos = weight_combinations if weight_combinations is not None else DEFAULT_WEIGHTS
    valid = [list(map(float, c)) for c in combos if len(c) == window_size]
    if not valid:
        valid = [[1.0 / window_size] * window_size]
    t = _lagged_series(df, target_column, time_column, keys, range(1, window_size + 1), 0.0)
    preds = [_weighted_lags(wt).alias(f"_p{i}") for i, wt in enumerate(valid)]
    wide = t.select(*[qcol(k) for k in keys], qcol(time_column), "actual", *preds)
    stacked = wide.select(*[qcol(k) for k in keys], qcol(time_column), "actual", F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.col(f"_p{i}").alias("predicted"))
        for i in range(len(valid))])).alias("_c")).select("*", "_c.*").drop("_c")
    m = forecast_metrics(stacked, by=keys + ["candidate"])
    wts = F.array(*[F.array(*[F.lit(x) for x in wt]) for wt in valid])
    rank = Window.partitionBy(*[qcol(k) for k in keys]).orderBy("mape", "candidate")
    return m.withColumn("weights", F.element_at(wts, F.col("candidate") + 1)) \
        .withColumn("_rk", F.row_number().over(rank)).filter("_rk = 1").drop("_rk")


def wma_forecast(df: DataFrame, target_column: str, weights, time_column: str = "time",
                 series_keys=(), test_size: float = 0.2, rows_per_block: int | None = None) -> DataFrame:
    keys = _as_list(series_keys)
    if not weights:
        raise OperatorError("weights required")
    t = _lagged_series(df, target_column, time_column, keys, range(1, len(weights) + 1), test_size,
                       rows_per_block)
    return t.select(*[qcol(k) for k in keys], qcol(time_column), "actual",
                    _weighted_lags(weights).alias("predicted"), "is_test")
