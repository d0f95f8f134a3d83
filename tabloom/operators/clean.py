"""Cleaning operators (CLN-1..13).

Each operator builds one projection (or one aggregate + one projection); the
statistics a fill needs (mean, median, mode) are scalars computed by a single
distributed aggregate and inlined as literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.expressions import (FLOAT_TYPES, OperatorError, col_type, is_missing,
                                           is_numeric, qcol, require_columns, string_columns)
from tabloom.operators import profile, windows
from tabloom.operators.relational import apply_mapping, standard_names, standardize_columns

# Recognisers used by type inference.
NUMERIC_RE = r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$"
DATE_PREFIX_RE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"


# Date layouts tried in order when no format is given (ISO first; month
# before day for slash dates, as pandas does without dayfirst).
DATE_FORMATS = ["yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d.M.yyyy", "M-d-yyyy"]


def parse_datetime(c, fmt: str | None = None):
    """Text -> timestamp; unparseable cells become NULL (``try_to_timestamp``)."""
    t = F.trim(c.cast("string"))
    if fmt:
        return F.try_to_timestamp(t, F.lit(fmt))
    tries = [F.try_to_timestamp(t)]
    for f in DATE_FORMATS:
        tries += [F.try_to_timestamp(t, F.lit(f + " H:m:s")), F.try_to_timestamp(t, F.lit(f))]
    return F.coalesce(*tries)


# --------------------------------------------------------------------------
# CLN-1 type inference
# --------------------------------------------------------------------------


def infer_types(df: DataFrame, columns=None, to_numeric: bool = True, to_datetime: bool = True,
                to_category: bool = True, threshold: float = 0.9, fmt: str | None = None,
                category_ratio: float = 0.05):
    """Convert text columns to double / timestamp / category by match ratios.

    Pass 1 is one aggregate of match counts for all columns (distinct counts
    for the category rule are HyperLogLog++ estimates, exact for small
    cardinalities, so no per-column Expand); pass 2 is one projection with
    ``try_cast`` / ``try_to_timestamp`` (bad cells -> NULL).
    Returns ``(converted_df, report_df)``; category columns stay text and carry
    ``{"category": true}`` column metadata.
    """
    cols = list(columns) if columns else string_columns(df)
    require_columns(df, cols)
    cols = [c for c in cols if isinstance(col_type(df, c), T.StringType)]
    if not cols:
        spark = df.sparkSession
        return df, spark.createDataFrame([], "column string, converted_to string, "
                                             "match_ratio double, nulls_after long")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = F.trim(qcol(c))
        aggs += [F.count(qcol(c)).alias(f"nn{i}"), F.count_if(v.rlike(NUMERIC_RE)).alias(f"num{i}"),
                 F.count_if(v.rlike(DATE_PREFIX_RE)).alias(f"dt{i}"),
                 F.approx_count_distinct(qcol(c)).alias(f"d{i}")]
    st = df.agg(*aggs).first()
    rows = st["_rows"]
    decision, ratio = {}, {}
    for i, c in enumerate(cols):
        nn = st[f"nn{i}"] or 0
        if nn == 0:
            continue
        if to_numeric and st[f"num{i}"] / nn > threshold:
            decision[c], ratio[c] = "double", st[f"num{i}"] / nn
        elif to_datetime and st[f"dt{i}"] / nn > threshold:
            decision[c], ratio[c] = "timestamp", st[f"dt{i}"] / nn
        elif to_category and rows and st[f"d{i}"] / rows < category_ratio:
            decision[c], ratio[c] = "category", st[f"d{i}"] / rows
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        kind = decision.get(f.name)
        if kind == "double":
            out.append(F.trim(c).try_cast("double").alias(f.name))
        elif kind == "timestamp":
            out.append(parse_datetime(c, fmt).alias(f.name))
        elif kind == "category":
            out.append(c.alias(f.name, metadata={"category": True}))
        else:
            out.append(c)
    converted = df.select(*out)
    spark = df.sparkSession
    report = spark.createDataFrame([(c, k, float(ratio[c])) for c, k in decision.items()],
                                   "column string, converted_to string, match_ratio double")
    if decision:
        nulls = profile.null_counts(converted, list(decision)).withColumnRenamed("null_count", "nulls_after")
        report = report.join(nulls, "column", "left")
    return converted, report


# --------------------------------------------------------------------------
# CLN-2 misaligned rows
# --------------------------------------------------------------------------


def fix_misaligned(df: DataFrame, columns=None, pattern: str = r"[,;\t]"):
    """Split cells holding separators into the following columns.

    Columns are processed in order; a cell matching ``pattern`` whose parts fit
    in the columns from it to the end keeps its first part and writes the rest
    over the next columns. Touched columns become text. One projection per
    suspect column, each referring to the previous step's columns by name (the
    split and the condition are computed once per step as columns), so the
    plan grows linearly with the number of columns. No row loop. Returns
    ``(fixed_df, fixed_cells_df)``.
    """
    names = list(df.columns)
    suspects = list(columns) if columns else string_columns(df)
    require_columns(df, suspects)
    cur = df.withColumn("_fixed", F.lit(0).cast("long"))
    for s in suspects:
        pos = names.index(s)
        src = qcol(s).cast("string")
        parts = F.split(src, pattern)
        step = cur.withColumn("_parts", parts).withColumn(
            "_cond", F.coalesce(src.rlike(pattern) & (F.size(parts) <= len(names) - pos), F.lit(False)))
        exprs = []
        for j, n in enumerate(names):
            if j < pos:
                exprs.append(qcol(n))
            elif j == pos:
                exprs.append(F.when(F.col("_cond"), F.col("_parts")[0]).otherwise(src).alias(n))
            else:
                i = j - pos
                exprs.append(F.when(F.col("_cond") & (F.size("_parts") > i), F.col("_parts")[i])
                             .otherwise(qcol(n).cast("string")).alias(n))
        cur = step.select(*exprs, (F.col("_fixed") + F.col("_cond").cast("long")).alias("_fixed"))
    return cur.drop("_fixed"), cur.agg(F.sum("_fixed").cast("long").alias("fixed_cells"))


# --------------------------------------------------------------------------
# CLN-3 .. CLN-7 missing values
# --------------------------------------------------------------------------

_METHODS = ("drop", "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward",
            "interpolate")


def fill(df: DataFrame, column: str | None = None, method: str = "drop", order_by=None,
         partition_by=(), approx: bool = False, rows_per_block: int | None = None) -> DataFrame:
    """Handle missing values in one column (or all columns when ``column`` is None)."""
    if method not in _METHODS:
        raise OperatorError(f"unsupported method {method!r}; use one of {_METHODS}")
    cols = [column] if column else list(df.columns)
    require_columns(df, cols)
    if method in ("fill_mean", "fill_median", "interpolate"):
        if column and not is_numeric(df, column):
            raise OperatorError(f"column {column!r} is not numeric; {method} needs numbers")
        cols = [c for c in cols if is_numeric(df, c)]
    if method == "drop":
        cond = None
        for c in cols:
            m = ~is_missing(df, c)
            cond = m if cond is None else cond & m
        return df.filter(cond)
    if method in ("fill_forward", "fill_backward", "interpolate"):
        if order_by is None:
            raise OperatorError(f"{method} needs order_by (Spark rows have no position)")
        return windows.fill_ordered(normalise(df, cols), cols, method, order_by, partition_by, rows_per_block)
    if method in ("fill_mean", "fill_median"):
        if not cols:
            return df
        if method == "fill_mean":
            st = df.agg(*[F.avg(_clean(df, c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
            values = {c: st[f"v{i}"] for i, c in enumerate(cols)}
        else:
            from tabloom.operators.quantiles import quantiles
            values = {c: q[0] for c, q in quantiles(df, cols, [0.5], approx=approx).items()}
    else:
        values = {c: profile.mode_value(normalise(df, [c]), c) for c in cols}
    return _fill_values(df, values)


def _clean(df, c):
    x = qcol(c)
    return F.when(~is_missing(df, c), x)


def normalise(df: DataFrame, cols) -> DataFrame:
    """NaN -> NULL for the given floating columns."""
    out = []
    for f in df.schema.fields:
        if f.name in cols and isinstance(f.dataType, FLOAT_TYPES):
            out.append(F.when(F.isnan(qcol(f.name)), F.lit(None).cast(f.dataType))
                       .otherwise(qcol(f.name)).alias(f.name))
        else:
            out.append(qcol(f.name))
    return df.select(*out)


def _fill_values(df: DataFrame, values: dict) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.name in values and values[f.name] is not None:
            v = F.lit(values[f.name])
            filled = F.when(is_missing(df, f.name), v).otherwise(qcol(f.name))
            if isinstance(f.dataType, T.NumericType):
                filled = filled.cast(T.DoubleType() if isinstance(values[f.name], float) and
                                     not isinstance(f.dataType, FLOAT_TYPES + (T.DecimalType,))
                                     else f.dataType)
            else:
                filled = filled.cast(f.dataType)
            out.append(filled.alias(f.name))
        else:
            out.append(qcol(f.name))
    return df.select(*out)


def fill_report(before: DataFrame, after: DataFrame, columns=None) -> DataFrame:
    """Cells filled = missing before − missing after (lazy: one job, two scans)."""
    cols = list(columns) if columns else [c for c in before.columns if c in after.columns]

    def side(d, tag):
        miss = reduce(lambda a, b: a + b, [F.count_if(is_missing(d, c)) for c in cols])
        return d.agg(F.count(F.lit(1)).alias("_rows"), miss.alias("_miss")).withColumn("_k", F.lit(tag))

    piv = side(before, "b").unionByName(side(after, "a")).groupBy().pivot("_k", ["b", "a"]) \
        .agg(F.first("_rows").alias("rows"), F.first("_miss").alias("miss"))
    return piv.select(F.col("b_rows").cast("long").alias("rows_before"), F.col("a_rows").cast("long").alias("rows_after"),
                      F.col("b_miss").cast("long").alias("missing_before"),
                      F.col("a_miss").cast("long").alias("missing_after"),
                      (F.col("b_miss") - F.col("a_miss")).cast("long").alias("cells_filled"))


# --------------------------------------------------------------------------
# CLN-9 .. CLN-11
# --------------------------------------------------------------------------


def drop_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Remove duplicate rows, keeping the first by ``order_by`` within ``subset``.

    Whole-row duplicates are identical, so plain ``dropDuplicates`` suffices;
    with a subset and an order, the first row per key is a ``min_by`` partial
    aggregate (a hot key is combined map-side, never held by one task).
    """
    if not subset or set(subset) == set(df.columns):
        return df.dropDuplicates()
    require_columns(df, subset)
    if order_by is None:
        return df.dropDuplicates(list(subset))
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [c for c in df.columns if c not in subset]
    first = F.min_by(F.struct(*[qcol(c) for c in others]), F.struct(*[qcol(k) for k in keys]))
    return df.groupBy(*[qcol(s) for s in subset]).agg(first.alias("_f")) \
        .select(*[qcol(s) for s in subset], "_f.*").select(*[qcol(c) for c in df.columns])


def clip(df: DataFrame, column: str, lower=None, upper=None) -> DataFrame:
    """CLN-10: clamp a numeric column into [lower, upper]."""
    require_columns(df, [column])
    c = qcol(column)
    if lower is not None:
        c = F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)
    if upper is not None:
        c = F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)
    return df.withColumn(column, c.cast(col_type(df, column)) if lower is None and upper is None
                         else c)


_CAST_NAMES = {"numeric": "double", "float": "double", "double": "double", "int": "bigint",
               "integer": "bigint", "string": "string", "text": "string", "datetime": "timestamp",
               "timestamp": "timestamp", "date": "date", "bool": "boolean", "boolean": "boolean",
               "category": "string"}


def cast_column(df: DataFrame, column: str, target_type: str) -> DataFrame:
    """CLN-11: cast with ``try_cast`` semantics (bad cells -> NULL)."""
    require_columns(df, [column])
    t = _CAST_NAMES.get(target_type.lower())
    if t is None:
        raise OperatorError(f"unknown target type {target_type!r}")
    c = qcol(column)
    if t == "timestamp":
        new = parse_datetime(c)
    else:
        new = c.cast("string").try_cast(t) if t != "string" else c.cast("string")
    return df.withColumn(column, new)


# --------------------------------------------------------------------------
# CLN-12 / CLN-13 plans
# --------------------------------------------------------------------------


def cleaning_plan(issues: DataFrame) -> DataFrame:
    """CLN-12: fixed rule per issue type -> action, parameters, priority, auto_apply."""
    t = F.col("type")
    action = F.when(t == "missing_values", "fill_median").when(t == "duplicate_rows", "drop_duplicates") \
        .when(t == "data_type", "cast").when(t == "column_name", "standardize_names") \
        .when(t == "outliers", "clip")
    priority = F.when(t == "missing_values", "high").when(t == "column_name", "low").otherwise("medium")
    auto = (t == "missing_values") | (t == "duplicate_rows")
    target = F.when(t == "data_type", F.coalesce(F.col("suggestion"), F.lit("string")))
    return issues.filter(action.isNotNull()).select(
        F.coalesce(F.col("column"), F.lit("all")).alias("column"), t.alias("issue_type"),
        action.alias("action"), priority.alias("priority"), auto.alias("auto_apply"),
        target.alias("target_type"), F.col("lower"), F.col("upper"))


def apply_plan(df: DataFrame, plan: DataFrame | list, mapping: dict | None = None,
               only_auto: bool = True):
    """CLN-13: rename by ``mapping``, then apply the plan steps in one lazy chain.

    ``plan`` is small (one row per issue) and is read on the driver. Returns
    ``(cleaned_df, summary_df)``.
    """
    steps = plan.collect() if isinstance(plan, DataFrame) else plan
    steps = [s.asDict() if hasattr(s, "asDict") else dict(s) for s in steps]
    if only_auto:
        steps = [s for s in steps if s.get("auto_apply")]
    mapping = mapping or {}
    out = apply_mapping(df, mapping)
    now = {c: mapping.get(c, c) for c in df.columns}  # source name -> present name
    applied = 0
    for s in steps:
        col = now.get(s["column"], s["column"])
        act = s["action"]
        if act == "drop_duplicates":
            out = drop_duplicates(out)
        elif act == "standardize_names":
            renamed = dict(zip(out.columns, standard_names(out.columns)))
            out = standardize_columns(out)
            now = {k: renamed.get(v, v) for k, v in now.items()}
        elif col not in out.columns:
            continue
        elif act == "fill_median":
            out = fill(out, col, "fill_median" if is_numeric(out, col) else "fill_mode")
        elif act == "cast":
            out = cast_column(out, col, s.get("target_type") or "string")
        elif act == "clip":
            out = clip(out, col, s.get("lower"), s.get("upper"))
        else:
            continue
        applied += 1
    # Summary stays lazy: one union of the two row counts, pivoted into a row.
    counts = df.select(F.lit("before").alias("_k")).unionByName(out.select(F.lit("after").alias("_k")))
    piv = counts.groupBy().pivot("_k", ["before", "after"]).count()
    summary = piv.select(
        F.coalesce(F.col("before"), F.lit(0)).cast("long").alias("rows_before"),
        F.lit(len(df.columns)).cast("long").alias("cols_before"),
        F.coalesce(F.col("after"), F.lit(0)).cast("long").alias("rows_after"),
        F.lit(len(out.columns)).cast("long").alias("cols_after"),
        (F.coalesce(F.col("before"), F.lit(0)) - F.coalesce(F.col("after"), F.lit(0))).cast("long")
        .alias("rows_removed"),
        F.lit(len(df.columns) - len(out.columns)).cast("long").alias("cols_removed"),
        F.lit(applied).cast("long").alias("steps_applied"))
    return out, summary
