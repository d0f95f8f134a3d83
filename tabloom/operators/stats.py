"""Statistics and feature scoring (STA-1..10).

All sums run as Spark aggregates over the whole table; only per-feature scalar
results (r, n, t, F, chi²) reach the p-value functions, which run in a
vectorised pandas UDF over the small result table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import cdf
from tabloom.functions.expressions import (OperatorError, normalise_nan, numeric_columns, present, qcol,
                                           require_columns, string_columns)
from tabloom.session import cut_lineage


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(cdf.t_sf_two_sided_v(t.astype(float).fillna(np.nan), dof.astype(float)))


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(cdf.f_sf_v(f.astype(float), d1.astype(float), d2.astype(float)))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(cdf.chi2_sf_v(x.astype(float), k.astype(float)))


def to_number(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``; NaN is missing."""
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


# --------------------------------------------------------------------------
# STA-1 / STA-2 correlation
# --------------------------------------------------------------------------


SMALL_DISTINCT = 1_000_000


def average_rank(df: DataFrame, column: str, name: str = "rank",
                 small_distinct: int | None = None) -> DataFrame:
    """Average-tie rank (1-based) of ``column`` over the whole table, see ``average_ranks``."""
    return average_ranks(df, {column: name}, small_distinct)


def average_ranks(df: DataFrame, columns: dict[str, str], small_distinct: int | None = None) -> DataFrame:
    """Average-tie ranks (1-based) of columns (column: name of its rank) over the
    whole table, distributed.

    Distinct values of all columns are counted in one ``groupBy``, kept, and tagged
    with value-range buckets (approximate quantile boundaries of the distinct values,
    ``Bucketizer``); bucket totals (one row per bucket) give each bucket's offset, and
    a running count inside each bucket gives every value's global rank, so no
    single-partition window is needed. The boundaries are literals, so retries are
    deterministic. Ranks are joined back on the value (AQE splits a hot value).
    With at most ``SMALL_DISTINCT`` distinct values (checked by a count) the
    values are ranked in one window directly.
    """
    import math
    from pyspark.ml.feature import Bucketizer
    from tabloom.operators.quantiles import ROWS_PER_BUCKET
    limit = SMALL_DISTINCT if small_distinct is None else small_distinct
    values = [present(df, c).cast("double") for c in columns]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), v.alias("_v")) for i, v in enumerate(values)]))
    counts = cut_lineage(df.select(each.alias("_e")).select("_e._k", "_e._v").filter("_v IS NOT NULL")
                         .groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    distinct = {r["_k"]: r["n"] for r in counts.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = {k: int(max(16, math.ceil(n / ROWS_PER_BUCKET))) for k, n in distinct.items() if n > limit}
    cuts = counts.agg(*[F.percentile_approx(F.when(F.col("_k") == k, F.col("_v")), [i / b for i in range(1, b)], 10 * b)
                        .alias(f"q{k}") for k, b in split.items()]).first() if split else None
    for k, (v, name) in enumerate(zip(values, columns.values())):
        own, value = counts.filter(F.col("_k") == k).drop("_k"), f"__tb_v{k}"
        if k not in split:
            # checked size: at most SMALL_DISTINCT distinct values ranked in one window
            w1 = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            cum = own.withColumn("_cum", F.sum("_c").over(w1))
        else:
            splits = [-math.inf] + (sorted({float(x) for x in cuts[f"q{k}"] if math.isfinite(x)}) or [0.0]) + [math.inf]
            tagged = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(own)
            rows, acc = [], 0
            for bucket, t in sorted((r["_b"], r["_t"]) for r in tagged.groupBy("_b").agg(F.sum("_c").alias("_t")).collect()):
                rows.append((float(bucket), int(acc)))
                acc += t
            offsets = df.sparkSession.createDataFrame(rows, "_b double, _off long")  # one row per bucket
            w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            cum = tagged.join(F.broadcast(offsets), "_b").withColumn("_cum", F.col("_off") + F.sum("_c").over(w))
        ranks = cum.select(F.col("_v").alias(value), (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(name))
        df = df.join(F.broadcast(ranks) if distinct.get(k, 0) <= 200_000 else ranks, v == F.col(value), "left").drop(value)
    return df


def _number(df: DataFrame, column: str) -> Column:
    """``to_number``; doubles and whole numbers are not written as text and read again."""
    exact = (T.DoubleType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if isinstance(df.select(qcol(column)).schema.fields[0].dataType, exact):
        v = qcol(column).cast("double")
        return F.when(~F.isnan(v), v)
    return to_number(qcol(column))


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson",
                small_distinct: int | None = None) -> DataFrame:
    """STA-1/2: r, n, t and the two-sided p-value on pairwise complete rows."""
    require_columns(df, [a, b])
    pair = df.select(_number(df, a).alias("_a"), _number(df, b).alias("_b")) \
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    if method == "spearman":
        pair = average_ranks(pair, {"_a": "_ra", "_b": "_rb"}, small_distinct).select(F.col("_ra").alias("_a"), F.col("_rb").alias("_b"))
    elif method != "pearson":
        raise OperatorError(f"unknown correlation method {method!r}")
    res = pair.agg(F.corr("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n"))
    rest = F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, rest))  # NULL for r = 1 and r = -1
    perfect = (rest < 1e-15) & (F.col("n") > 2)
    return res.select(F.lit(method).alias("method"), "r", "n", t.alias("t"), perfect.alias("__tb_p")) \
        .withColumn("p_value", F.when(F.col("__tb_p"), F.lit(0.0))
                    .when(F.col("t").isNotNull(), t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")))).drop("__tb_p")


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson r for all column pairs in one aggregate; long format."""
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        raise OperatorError("need at least two columns")
    df = normalise_nan(df)
    wide = df.agg(*[F.corr(qcol(cols[i]).cast("double"), qcol(cols[j]).cast("double")).alias(f"r{i}_{j}")
                    for i, j in pairs])
    rows = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                     F.col(f"r{i}_{j}").alias("r")) for i, j in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


# --------------------------------------------------------------------------
# STA-3 / STA-4 / STA-5 outliers
# --------------------------------------------------------------------------


def zscore_bounds(df: DataFrame, column: str, k: float = 3.0):
    v = present(df, column)
    row = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
    if row["m"] is None or row["s"] is None:
        return None, None
    return row["m"] - k * row["s"], row["m"] + k * row["s"]


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5, approx: bool = False):
    from tabloom.operators.quantiles import quantiles
    q1, q3 = quantiles(normalise_nan(df.select(qcol(column))), [column], [0.25, 0.75], approx=approx)[column]
    if q1 is None:
        return None, None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def outliers(df: DataFrame, column: str, method: str = "zscore", k: float | None = None,
             approx: bool = False) -> DataFrame:
    """STA-3/4: rows outside mean ± k·std (k=3) or Q1-k·IQR..Q3+k·IQR (k=1.5).

    The bounds are two scalars from one aggregate; the rows come from a plain
    filter with literal bounds (pushed into the scan where possible).
    """
    require_columns(df, [column])
    if method == "zscore":
        lo, hi = zscore_bounds(df, column, 3.0 if k is None else k)
        c = present(df, column)
        if lo is None:
            return df.limit(0)
        return df.filter((F.abs(c - F.lit((lo + hi) / 2)) > F.lit((hi - lo) / 2)))
    if method == "iqr":
        lo, hi = iqr_bounds(df, column, 1.5 if k is None else k, approx)
        if lo is None:
            return df.limit(0)
        c = present(df, column)
        return df.filter((c < F.lit(lo)) | (c > F.lit(hi)))
    raise OperatorError(f"unknown outlier method {method!r}")


def outlier_counts(df: DataFrame, columns=None, k: float = 1.5, approx: bool = False) -> DataFrame:
    """IQR outlier bounds and counts for all columns: two fused aggregates."""
    cols = list(columns) if columns else numeric_columns(df)
    df = normalise_nan(df.select(*[qcol(c) for c in cols]))
    from tabloom.operators.quantiles import quantiles
    qs = quantiles(df, cols, [0.25, 0.75], approx=approx)
    bounds = {}
    for c in cols:
        q = qs[c]
        if q[0] is not None:
            bounds[c] = (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0]))
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, count long, lower double, upper double")
    counts = df.agg(*[F.count_if((qcol(c) < F.lit(lo)) | (qcol(c) > F.lit(hi))).alias(f"n{i}")
                      for i, (c, (lo, hi)) in enumerate(bounds.items())])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                     F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"))
            for i, (c, (lo, hi)) in enumerate(bounds.items())]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def seconds_between(t1: Column, t2: Column) -> Column:
    return (F.unix_micros(t2.cast("timestamp")) - F.unix_micros(t1.cast("timestamp"))) / 1e6


def lag_analysis(df: DataFrame, t1: str, t2: str, k: float = 3.0):
    """STA-5: lag seconds between two time columns: summary + outlying rows."""
    require_columns(df, [t1, t2])
    lagged = df.withColumn("lag_seconds", seconds_between(qcol(t1), qcol(t2)))
    c = F.col("lag_seconds")
    from tabloom.operators.profile import describe
    summary = describe(lagged, ["lag_seconds"]).drop("column")
    return lagged, summary


def lag_outliers(lagged: DataFrame, k: float = 3.0) -> DataFrame:
    lo, hi = zscore_bounds(lagged, "lag_seconds", k)
    if lo is None:
        return lagged.limit(0)
    c = F.col("lag_seconds")
    return lagged.filter((c < F.lit(lo)) | (c > F.lit(hi)))


# --------------------------------------------------------------------------
# STA-6 .. STA-10 feature scores
# --------------------------------------------------------------------------


def t_test_by_label(df: DataFrame, label: Column, features) -> DataFrame:
    """STA-6: pooled two-sample t per feature (label true vs false), one aggregate."""
    feats = list(features)
    df = normalise_nan(df)
    pos, neg = label, ~label
    aggs = []
    for i, f in enumerate(feats):
        c = qcol(f).cast("double")
        for tag, cond in (("1", pos), ("0", neg)):
            v = F.when(cond, c)
            aggs += [F.count(v).alias(f"n{tag}_{i}"), F.avg(v).alias(f"m{tag}_{i}"),
                     F.var_samp(v).alias(f"v{tag}_{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"),
                     *[F.col(f"{s}{tag}_{i}").alias(f"{s}{tag}") for tag in ("1", "0") for s in "nmv"])
            for i, f in enumerate(feats)]
    t = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    dof = F.col("n1") + F.col("n0") - 2
    sp = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / dof
    tstat = (F.col("m1") - F.col("m0")) / F.sqrt(sp * (1.0 / F.col("n1") + 1.0 / F.col("n0")))
    return t.select("feature", F.col("n1").alias("n_fault"), F.col("n0").alias("n_normal"),
                    F.col("m1").alias("mean_fault"), F.col("m0").alias("mean_normal"),
                    tstat.alias("t"), dof.cast("double").alias("dof")) \
        .withColumn("p_value", t_pvalue(F.col("t"), F.col("dof")))


def f_regression(df: DataFrame, features, target: str) -> DataFrame:
    """STA-7: F = r²/(1-r²)·(n-2) per feature against a numeric target."""
    feats = list(features)
    df = normalise_nan(df)
    y = qcol(target).cast("double")
    aggs = []
    for i, f in enumerate(feats):
        x = qcol(f).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, f in enumerate(feats)]
    t = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    r2 = F.col("r") * F.col("r")
    perfect = r2 >= 1 - 1e-15
    fstat = F.when(perfect, F.lit(float("inf"))).otherwise(F.try_divide(r2, 1 - r2) * (F.col("n") - 2))
    return t.select("feature", fstat.alias("score"), "n", perfect.alias("__tb_p")) \
        .withColumn("p_value", F.when(F.col("__tb_p"), F.lit(0.0))
                    .when(F.col("score").isNotNull(), f_pvalue(F.col("score"), F.lit(1.0), (F.col("n") - 2).cast("double")))) \
        .drop("__tb_p")


def chi2_scores(df: DataFrame, features, target: str) -> DataFrame:
    """STA-8: chi² of non-negative features against class labels.

    Observed = Σx per class; expected = class share · Σx; one groupBy by class
    (small output: classes × features), then per-feature sums.
    """
    feats = list(features)
    per_class = df.groupBy(qcol(target).alias("_y")).agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.sum(qcol(f).cast("double")).alias(f"s{i}")
                                           for i, f in enumerate(feats)])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("obs")) for i, f in enumerate(feats)]
    long = per_class.select("_y", "_cnt", F.explode(F.array(*rows)).alias("_r")).select("_y", "_cnt", "_r.*")
    w = Window.partitionBy("feature")
    exp = F.col("_cnt") / F.sum("_cnt").over(w) * F.sum("obs").over(w)
    scored = long.withColumn("_e", exp).withColumn("_k", F.count(F.lit(1)).over(w))
    res = scored.groupBy("feature").agg(
        F.sum((F.col("obs") - F.col("_e")) ** 2 / F.col("_e")).alias("score"),
        F.first("_k").alias("_k"))
    return res.withColumn("p_value", chi2_pvalue(F.col("score"), (F.col("_k") - 1).cast("double"))) \
        .drop("_k")


def mutual_info(df: DataFrame, features, target: str, bins: int = 10, classification=True) -> DataFrame:
    """STA-9: binned mutual information (nats) of each feature with the target.

    Features (and a numeric target) are cut at approximate quantiles
    (``percentile_approx``, one aggregate); then ``groupBy(feature, bin, y)``
    counts give Σ p·ln(p/(p_x·p_y)). Differs from a kNN estimator by design.
    """
    feats = list(features)
    probs = [i / bins for i in range(1, bins)]
    q = df.agg(*[F.percentile_approx(qcol(f).cast("double"), probs, 10000).alias(f"q{i}")
                 for i, f in enumerate(feats)],
               *([] if classification else [F.percentile_approx(qcol(target).cast("double"), probs, 10000)
                                            .alias("qy")])).first()

    def binned(c: Column, edges) -> Column:
        e = sorted(set(float(x) for x in edges))
        expr = F.lit(len(e))
        for j in reversed(range(len(e))):
            expr = F.when(c <= F.lit(e[j]), F.lit(j)).otherwise(expr)
        return expr

    y = qcol(target).cast("string") if classification else binned(qcol(target).cast("double"), q["qy"])
    parts = [F.struct(F.lit(f).alias("feature"), binned(qcol(f).cast("double"), q[f"q{i}"]).alias("bx"))
             for i, f in enumerate(feats)]
    long = df.select(y.cast("string").alias("y"), F.explode(F.array(*parts)).alias("_r")) \
        .select("y", "_r.*")
    joint = long.groupBy("feature", "bx", "y").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    wx = Window.partitionBy("feature", "bx")
    wy = Window.partitionBy("feature", "y")
    n = F.sum("nxy").over(wf)
    term = F.col("nxy") / n * F.log(F.col("nxy") * n / (F.sum("nxy").over(wx) * F.sum("nxy").over(wy)))
    return joint.withColumn("_t", term).groupBy("feature").agg(F.sum("_t").alias("score"))


def detect_tasks(df: DataFrame, columns=None, max_classes: int = 10) -> DataFrame:
    """STA-10 for many candidate targets at once: one fused distinct-count
    aggregate, then 'classification' for text/boolean or < ``max_classes``
    distinct values, else 'regression'."""
    cols = list(columns) if columns else list(df.columns)
    dtypes = dict(df.dtypes)
    wide = df.agg(*[F.count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct"),
                     F.lit(dtypes[c] in ("string", "boolean")).alias("_txt")) for i, c in enumerate(cols)]
    t = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    task = F.when(F.col("_txt") | (F.col("distinct") < max_classes), "classification").otherwise("regression")
    return t.select("column", "distinct", task.alias("task"))


def detect_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """STA-10: 'classification' for text targets or < 10 distinct values."""
    require_columns(df, [target])
    if target in string_columns(df) or dict(df.dtypes)[target] == "boolean":
        return "classification"
    distinct = df.agg(F.count_distinct(qcol(target))).first()[0]
    return "classification" if distinct < max_classes else "regression"
