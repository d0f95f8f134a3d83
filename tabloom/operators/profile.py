"""Profiling aggregates (AGG-1..11), each fused into as few scans as possible.

Rule: all per-column statistics of one operator come out of a single ``agg``
(one scan, map-side partial aggregation); the one-row result is turned into one
row per column with ``explode(array(struct...))`` so the output stays a lazy
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.expressions import (OperatorError, as_list, is_missing, normalise_nan, numeric_columns, present, qcol,
                                           require_columns)

_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _rows_from_wide(wide: DataFrame, names, fields) -> DataFrame:
    """One-row ``wide`` with columns ``{i}__{field}`` -> one row per name."""
    structs = [F.struct(F.lit(n).alias("column"),
                        *[F.col(f"`{i}__{f}`").alias(f) for f in fields])
               for i, n in enumerate(names)]
    return wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def _quantiles(c: Column, probs, approx: bool):
    if approx:
        return F.percentile_approx(c, list(probs), 10000)
    return F.percentile(c, list(probs))


def describe(df: DataFrame, columns=None, approx: bool = False, mode: str = "auto") -> DataFrame:
    """AGG-1: count, mean, std (n-1), min, 25/50/75 %, max per numeric column.

    Quartiles: ``approx`` uses ``percentile_approx``; otherwise exact, either
    fused into the one aggregate (``mode="global"``, small tables) or found by
    the bucketed distributed plan of :mod:`tabloom.operators.quantiles`
    (``"distributed"``); ``"auto"`` picks by the number of cells.
    """
    from tabloom.operators.quantiles import GLOBAL_LIMIT, quantiles
    cols = list(columns) if columns else numeric_columns(df)
    require_columns(df, cols)
    if not cols:
        raise OperatorError("describe needs at least one numeric column")
    df = normalise_nan(df.select(*[qcol(c) for c in cols]))
    if not approx and mode == "auto":
        mode = "global" if df.count() * len(cols) <= GLOBAL_LIMIT else "distributed"
    qs = quantiles(df, cols, (0.25, 0.5, 0.75), mode="distributed") \
        if (not approx and mode == "distributed") else None
    aggs = []
    for i, n in enumerate(cols):
        c = qcol(n).cast("double")
        aggs += [F.count(c).alias(f"{i}__count"), F.avg(c).alias(f"{i}__mean"),
                 F.stddev_samp(c).alias(f"{i}__std"), F.min(c).alias(f"{i}__min"), F.max(c).alias(f"{i}__max")]
        if qs is None:
            aggs.append(_quantiles(c, (0.25, 0.5, 0.75), approx).alias(f"{i}__q"))
    wide = df.agg(*aggs)
    if qs is None:
        wide = wide.select("*", *[F.col(f"{i}__q")[k].alias(f"{i}__{s}")
                                  for i in range(len(cols)) for k, s in enumerate(("p25", "p50", "p75"))])
    else:
        wide = wide.select("*", *[F.lit(qs[n][k]).cast("double").alias(f"{i}__{s}")
                                  for i, n in enumerate(cols) for k, s in enumerate(("p25", "p50", "p75"))])
    return _rows_from_wide(wide, cols, _STATS)


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """AGG-2: missing (NULL or NaN) count per column."""
    cols = list(columns) if columns else list(df.columns)
    wide = df.agg(*[F.count_if(is_missing(df, n)).alias(f"{i}__null_count") for i, n in enumerate(cols)])
    return _rows_from_wide(wide, cols, ["null_count"])


def unique_counts(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """AGG-3: distinct non-null values per column (``approx`` = HyperLogLog++)."""
    cols = list(columns) if columns else list(df.columns)
    df = normalise_nan(df.select(*[qcol(c) for c in cols]))
    if not approx:
        return distinct_table(df, cols)
    wide = df.agg(*[F.approx_count_distinct(qcol(n)).alias(f"{i}__unique_count") for i, n in enumerate(cols)])
    return _rows_from_wide(wide, cols, ["unique_count"])


def distinct_table(df: DataFrame, cols) -> DataFrame:
    """(column, unique_count) by two aggregates over one stacked table of (column
    number, value hash): no row is expanded once per column, and 20 bytes a cell
    are shuffled after the map-side aggregate. Values meet by a 128-bit hash."""
    cells = [F.struct(F.lit(i).alias("i"), F.when(qcol(c).isNotNull(), F.xxhash64(F.lit(1), qcol(c))).alias("h"),
                      F.xxhash64(F.lit(2), qcol(c)).alias("g")) for i, c in enumerate(cols)]
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("h IS NOT NULL").distinct()
    names = F.array(*[F.lit(c) for c in cols])
    counted = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))
    return every.join(F.broadcast(counted), "i", "left") \
        .select(F.element_at(names, F.col("i") + 1).alias("column"), F.coalesce("n", F.lit(0)).alias("unique_count"))


def inspect(df: DataFrame, describe_numeric: bool = True, nulls: bool = True,
            uniques: bool = True, approx: bool = False) -> DataFrame:
    """AGG-4: dtype + row count + chosen AGG-1..3 statistics: one fused ``agg``, and
    one stacked value table for exact distinct counts."""
    cols = list(df.columns)
    df = normalise_nan(df)
    nums = set(numeric_columns(df))
    dtypes = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    fields = ["rows"]
    for i, n in enumerate(cols):
        c = qcol(n)
        if nulls:
            aggs.append(F.count_if(is_missing(df, n)).alias(f"{i}__null_count"))
        if uniques and approx:
            aggs.append(F.approx_count_distinct(c).alias(f"{i}__unique_count"))
        if describe_numeric:
            d = c.cast("double") if n in nums else F.lit(None).cast("double")
            aggs += [F.avg(d).alias(f"{i}__mean"), F.stddev_samp(d).alias(f"{i}__std"),
                     F.min(d).alias(f"{i}__min"), F.max(d).alias(f"{i}__max")]
    if nulls:
        fields.append("null_count")
    if uniques and approx:
        fields.append("unique_count")
    if describe_numeric:
        fields += ["mean", "std", "min", "max"]
    wide = df.agg(*aggs).select("*", *[F.col("_rows").alias(f"{i}__rows") for i in range(len(cols))])
    out = _rows_from_wide(wide, cols, fields)
    if uniques and not approx:
        out = out.join(F.broadcast(distinct_table(df, cols)), "column")  # one row per column
    types = F.create_map(*[x for n in cols for x in (F.lit(n), F.lit(dtypes[n]))])
    return out.withColumn("dtype", types[F.col("column")])


def missing_summary(df: DataFrame):
    """AGG-5: per-column missing count / % (2 dp) / dtype, plus a totals row.

    Returns ``(per_column, totals)``; an empty table gives 0 %, not NaN.
    """
    cols = list(df.columns)
    dtypes = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(is_missing(df, n)).alias(f"{i}__missing_count")
                    for i, n in enumerate(cols)])
    for i in range(len(cols)):
        wide = wide.withColumn(f"{i}__rows", F.col("_rows"))
    per = _rows_from_wide(wide, cols, ["missing_count", "rows"])
    types = F.create_map(*[x for n in cols for x in (F.lit(n), F.lit(dtypes[n]))])
    pct = F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("missing_count") * 100.0 / F.col("rows"), 2))
    per = per.select("column", "missing_count", pct.alias("missing_pct"),
                     types[F.col("column")].alias("dtype"))
    totals = _totals(wide, cols)
    return per, totals


def _totals(wide: DataFrame, cols) -> DataFrame:
    miss = [F.col(f"`{i}__missing_count`") for i in range(len(cols))]
    total_missing = sum(miss[1:], miss[0]) if miss else F.lit(0)
    cells = F.col("_rows") * F.lit(len(cols))
    with_missing = sum([(m > 0).cast("long") for m in miss[1:]], (miss[0] > 0).cast("long")) \
        if miss else F.lit(0)
    return wide.select(total_missing.cast("long").alias("total_missing"),
                       cells.cast("long").alias("total_cells"),
                       F.when(cells == 0, F.lit(0.0)).otherwise(
                           F.round(total_missing * 100.0 / cells, 2)).alias("total_missing_pct"),
                       with_missing.cast("long").alias("columns_with_missing"))


def group_stats(df: DataFrame, by, column: str) -> DataFrame:
    """AGG-6: mean/min/max of ``column`` per group, and the number of groups."""
    keys = [by] if isinstance(by, str) else list(by)
    require_columns(df, keys + [column])
    df = normalise_nan(df)
    c = qcol(column)
    g = df.groupBy(*[qcol(k) for k in keys]).agg(F.avg(c).alias("mean"), F.min(c).alias("min"),
                                                 F.max(c).alias("max"), F.count(c).alias("count"))
    return g


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """AGG-7: rows after the first occurrence of each distinct row."""
    cols = list(subset) if subset else list(df.columns)
    return df.groupBy(*[qcol(c) for c in cols]).count() \
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def mode_value(df: DataFrame, column: str):
    """AGG-8: most frequent non-null value, lowest on ties (a scalar).

    ``groupBy(value).count`` spreads the distinct values over the cluster; the
    maximum count and the lowest value holding it are then two partial
    aggregates, so no task ever holds all distinct values.
    """
    df = normalise_nan(df.select(qcol(column)))
    c = qcol(column)
    counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).count()
    top = counts.agg(F.max("count").alias("m")).first()["m"]
    if top is None:
        return None
    return counts.filter(F.col("count") == top).agg(F.min("v")).first()[0]


def modes(df: DataFrame, columns=None) -> DataFrame:
    """AGG-8 as a table: (column, mode, count) per column, lazily.

    Each column's values are counted by ``groupBy(column, value)`` over a
    stacked (column, value-as-text) projection, ranked by count then value.
    Numeric columns are compared numerically via a sortable key.
    """
    cols = list(columns) if columns else list(df.columns)
    df = normalise_nan(df.select(*[qcol(c) for c in cols]))
    nums = set(numeric_columns(df))
    parts = []
    for n in cols:
        c = qcol(n)
        key = F.struct(c.cast("double").alias("d"), F.lit(None).cast("string").alias("s")) if n in nums \
            else F.struct(F.lit(None).cast("double").alias("d"), c.cast("string").alias("s"))
        parts.append(F.struct(F.lit(n).alias("column"), key.alias("k"), c.cast("string").alias("v")))
    stacked = df.select(F.explode(F.array(*parts)).alias("_x")).select("_x.*") \
        .filter(F.col("v").isNotNull())
    counts = stacked.groupBy("column", "k", "v").count()
    top = F.broadcast(counts.groupBy("column").agg(F.max("count").alias("_m")))  # one row per column
    return counts.join(top, "column").filter(F.col("count") == F.col("_m")) \
        .groupBy("column").agg(F.min(F.struct("k", "v")).alias("_b"), F.max("count").alias("count")) \
        .select("column", F.col("_b.v").alias("mode"), "count")


def zero_share(df: DataFrame, column: str, by=()) -> DataFrame:
    """AGG-9: percentage of zeros in a series (intermittency)."""
    keys = [by] if isinstance(by, str) else list(by)
    e = (F.avg((qcol(column) == 0).cast("double")) * 100).alias("zero_pct")
    return df.groupBy(*[qcol(k) for k in keys]).agg(e) if keys else df.agg(e)


def covariance_matrix(df: DataFrame, columns, where: Column | None = None) -> DataFrame:
    """AGG-10: mean vector and sample covariance for all d(d+1)/2 pairs in one agg.

    Returns rows (i, j, col_i, col_j, cov) for i <= j plus ``mean_i`` columns.
    """
    cols = list(columns)
    src = df.filter(where) if where is not None else df
    aggs = [F.avg(qcol(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs += [F.covar_samp(qcol(cols[i]).cast("double"), qcol(cols[j]).cast("double")).alias(f"c{i}_{j}")
             for i, j in pairs]
    aggs.append(F.count(F.lit(1)).alias("n"))
    wide = src.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("col_i"),
                     F.lit(cols[j]).alias("col_j"), F.col(f"c{i}_{j}").alias("cov"),
                     F.col(f"m{i}").alias("mean_i"), F.col(f"m{j}").alias("mean_j"))
            for i, j in pairs]
    return wide.select("n", F.explode(F.array(*rows)).alias("_r")).select("n", "_r.*")


def eda_summary(df: DataFrame, time_column: str, measures, unit: str = "month", group=None) -> dict:
    """AGG-11: the automatic report's tables (base stats, trend, relationships,
    anomalies) as lazy DataFrames.

    ``group`` (one column or several) adds ``comparison``, one row per group and
    measure, and splits the trend by group. A missing group value is a group of
    its own; a hot group is summed inside tasks first.
    """
    from tabloom.operators.stats import correlation_matrix, outlier_counts
    measures, by = list(measures), as_list(group)
    require_columns(df, [time_column, *measures, *by])
    taken = {"period", "measure", "rows", "count", "mean", "std", "min", "max", "share", "lift", *measures} & set(by)
    if taken:
        raise OperatorError(f"rename the group columns {sorted(taken)}: the tables have columns of these names")
    base = describe(df, measures)
    trend = df.groupBy(F.date_trunc(unit, qcol(time_column)).alias("period"), *[qcol(g) for g in by]).agg(
        *[F.avg(present(df, m)).alias(m) for m in measures], F.count(F.lit(1)).alias("rows"))
    rel = correlation_matrix(df, measures) if len(measures) > 1 else None
    anomalies = outlier_counts(df, measures)
    found = {"base": base, "trend": trend, "relationships": rel, "anomalies": anomalies}
    if by:
        found["comparison"] = _comparison(df, measures, by)
    return found


def _comparison(df: DataFrame, measures, by) -> DataFrame:
    """Per group and measure: rows, present values, mean, std (n-1), min, max, the
    group's share of the measure's sum and its mean against the mean of all groups'
    rows (``lift``)."""
    cells = df.select(*[qcol(g) for g in by], F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), present(df, m).cast("double").alias("x")) for m in measures])).alias("__tb_c"))
    x, key = F.col("__tb_c.x"), F.col("__tb_c.measure")
    per = cells.groupBy(*[qcol(g) for g in by], key.alias("measure")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("__tb_sum"))
    # One row per measure.
    whole = per.groupBy(F.col("measure").alias("__tb_m")).agg(F.sum("__tb_sum").alias("__tb_all"), F.sum("count").alias("__tb_n"))
    return per.join(F.broadcast(whole), F.col("measure") == F.col("__tb_m")).select(
        *[qcol(g) for g in by], "measure", "rows", "count", "mean", "std", "min", "max",
        F.try_divide("__tb_sum", "__tb_all").alias("share"),
        F.try_divide(F.col("mean"), F.try_divide("__tb_all", "__tb_n")).alias("lift"))
