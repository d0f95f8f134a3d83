"""Forecast metrics, future periods, summaries and backtest choice (FCT-11, 16-18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import as_list as _as_list, OperatorError, qcol

EPSILON = 1e-10


def metric_exprs(a: Column, p: Column, zero: str = "epsilon") -> list[Column]:
    """MAPE (fraction), MAE, MSE, RMSE, R², n as aggregate expressions."""
    err = p - a
    if zero == "epsilon":
        mape = F.avg(F.abs(err / F.when(a == 0, F.lit(EPSILON)).otherwise(a)))
    elif zero == "skip":
        mape = F.avg(F.when(a != 0, F.abs(err / a)))
    else:
        raise OperatorError("zero must be 'epsilon' or 'skip'")
    mse = F.avg(err * err)
    ss_res = F.sum(err * err)
    ss_tot = F.var_pop(a) * F.count(a)
    r2 = F.when(ss_tot == 0, F.lit(0.0)).otherwise(1 - ss_res / ss_tot)
    return [mape.alias("mape"), F.avg(F.abs(err)).alias("mae"), mse.alias("mse"),
            F.sqrt(mse).alias("rmse"), r2.alias("r2"), F.count(F.lit(1)).alias("n")]


def forecast_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by=(), zero: str = "epsilon") -> DataFrame:
    """FCT-11: one ``groupBy(by).agg`` over rows with both values present."""
    keys = _as_list(by)
    scored = df.filter(qcol(actual).isNotNull() & qcol(predicted).isNotNull())
    exprs = metric_exprs(qcol(actual).cast("double"), qcol(predicted).cast("double"), zero)
    if keys:
        return scored.groupBy(*[qcol(k) for k in keys]).agg(*exprs)
    return scored.agg(*exprs)


def future_periods(last: DataFrame, time_column: str, extra_periods: int,
                   unit: str = "month", by=()) -> DataFrame:
    """FCT-16: ``extra_periods`` next periods after each series' last time.

    ``last`` holds one row per series (``by`` + ``time_column``); ``unit`` is
    month, quarter, day or index (integer step).
    """
    keys = _as_list(by)
    step = F.explode(F.sequence(F.lit(1), F.lit(int(extra_periods)))).alias("step")
    base = last.select(*[qcol(k) for k in keys], qcol(time_column).alias("_last"), step)
    t = F.col("_last")
    if unit == "month":
        nxt = F.add_months(t, F.col("step"))
    elif unit == "quarter":
        nxt = F.add_months(t, F.col("step") * 3)
    elif unit == "day":
        nxt = F.date_add(t, F.col("step"))
    elif unit == "index":
        nxt = t + F.col("step")
    else:
        raise OperatorError(f"unknown period unit {unit!r}")
    return base.select(*[qcol(k) for k in keys], "step", nxt.alias(time_column))


def quarter_label(year: Column, quarter: Column) -> Column:
    """Quarter text ``YYYY 第N季度`` (fixed format of the forecasting inputs)."""
    return F.concat(year.cast("string"), F.lit(" 第"), quarter.cast("string"), F.lit("季度"))


def forecast_summary(forecasts: DataFrame, by=(), time_column: str = "time",
                     actual: str = "actual", predicted: str = "predicted",
                     flag: str = "is_test") -> DataFrame:
    """FCT-17: per series counts, train/test date ranges and value lists."""
    keys = _as_list(by)
    t, is_test = qcol(time_column), qcol(flag)
    ordered = F.struct(t.alias("t"), qcol(actual).alias("a"), qcol(predicted).alias("p"))
    agg = forecasts.groupBy(*[qcol(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~is_test).alias("train_count"),
        F.count_if(is_test).alias("test_count"),
        F.min(F.when(~is_test, t)).alias("train_start"),
        F.max(F.when(~is_test, t)).alias("train_end"),
        F.min(F.when(is_test, t)).alias("test_start"),
        F.max(F.when(is_test, t)).alias("test_end"),
        F.sort_array(F.collect_list(F.when(is_test, ordered))).alias("_test"),
    )
    return agg.select("*", F.col("_test.a").alias("actual_values"),
                      F.col("_test.p").alias("predicted_values")).drop("_test")


def choose_best(metrics_tables, by=(), score: str = "mape", method_col: str = "method") -> DataFrame:
    """FCT-18: union the per-method metric tables and keep the best per series."""
    keys = _as_list(by)
    allm = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(metrics_tables))
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(qcol(score).asc_nulls_last(),
                                                             qcol(method_col))
    return allm.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


# Method catalogue by category (used by the listing operator).
METHODS = {
    "statistical": ["sma", "wma", "single_smoothing", "double_smoothing", "triple_smoothing", "arima"],
    "intermittent": ["croston", "sba", "tsb"],
    "machine_learning": ["random_forest", "boosted_trees"],
    "neural": ["lag_network"],
}


def list_methods(spark) -> DataFrame:
    rows = [(cat, m) for cat, ms in METHODS.items() for m in ms]
    return spark.createDataFrame(rows, "category string, method string")
