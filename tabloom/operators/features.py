"""Feature engineering (FE-1..9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, is_numeric, qcol, require_columns

_OPS = ("multiply", "add", "subtract", "divide", "log_multiply")


def interaction(df: DataFrame, name: str, columns, op: str = "multiply", scale: bool = False) -> DataFrame:
    """FE-1..6: product / sum / difference / ratio / product of logs of numeric
    columns (cast to double first), optionally standardised (mean 0, std 1)."""
    cols = list(columns)
    require_columns(df, cols)
    bad = [c for c in cols if not is_numeric(df, c)]
    if bad:
        raise OperatorError(f"non-numeric columns: {bad}")
    if op not in _OPS:
        raise OperatorError(f"unknown op {op!r}; use one of {_OPS}")
    if len(cols) < 2:
        raise OperatorError("need at least two columns")
    x = [qcol(c).cast("double") for c in cols]
    if op == "multiply":
        e = reduce(lambda a, b: a * b, x)
    elif op == "add":
        e = reduce(lambda a, b: a + b, x)
    elif op in ("subtract", "divide"):
        if len(cols) != 2:
            raise OperatorError(f"{op} takes exactly two columns")
        e = x[0] - x[1] if op == "subtract" else F.try_divide(x[0], F.when(x[1] != 0, x[1]))
    else:
        e = reduce(lambda a, b: a * b, [F.log(F.greatest(c, F.lit(1e-10))) for c in x])
    out = df.withColumn(name, e)
    return standardize(out, name) if scale else out


def standardize(df: DataFrame, column: str) -> DataFrame:
    """FE-6: (x − mean) / std (n−1); the two scalars come from one aggregate."""
    row = df.agg(F.avg(qcol(column)).alias("m"), F.stddev_samp(qcol(column)).alias("s")).first()
    if row["s"] in (None, 0):
        return df.withColumn(column, F.lit(0.0))
    return df.withColumn(column, (qcol(column) - F.lit(row["m"])) / F.lit(row["s"]))


def label_encode(df: DataFrame, column: str, output: str | None = None):
    """FE-7: alphabetical label codes 0..k-1 (``StringIndexer(alphabetAsc)``).

    Returns ``(encoded_df, fitted_indexer)``; decode with ``IndexToString``
    using ``indexer.labels``.
    """
    from pyspark.ml.feature import StringIndexer
    out = output or f"{column}_code"
    model = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    return model.transform(df), model


def label_decode(df: DataFrame, column: str, labels, output: str | None = None) -> DataFrame:
    from pyspark.ml.feature import IndexToString
    return IndexToString(inputCol=column, outputCol=output or f"{column}_decoded", labels=list(labels)).transform(df)


def minmax_scale(df: DataFrame, column: str, by=(), name: str | None = None) -> DataFrame:
    """FE-8: (x − min) / (max − min) per series (group min/max joined back)."""
    keys = [by] if isinstance(by, str) else list(by)
    out = name or f"{column}_scaled"
    c = qcol(column)
    if keys:
        st = df.groupBy(*[qcol(k) for k in keys]).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
        j = df.join(st, keys, "left")
    else:
        row = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi")).first()
        j = df.withColumn("_lo", F.lit(row["_lo"])).withColumn("_hi", F.lit(row["_hi"]))
    rng = F.col("_hi") - F.col("_lo")
    return j.withColumn(out, F.when(rng == 0, F.lit(0.0)).otherwise((c - F.col("_lo")) / rng)).drop("_lo", "_hi")


def minmax_inverse(c, lo: float, hi: float):
    return c * F.lit(hi - lo) + F.lit(lo)


# Fixed value: quarter text pattern "YYYY 第N季度".
QUARTER_RE = r"^\s*(\d{4})\s*第\s*(\d)\s*季度\s*$"


def time_parts(df: DataFrame, time_column: str) -> DataFrame:
    """The calendar columns of FE-9 (year, month, quarter), row by row, so also on streams."""
    require_columns(df, [time_column])
    c = qcol(time_column)
    txt = c.cast("string")
    qy = F.regexp_extract(txt, QUARTER_RE, 1)
    qq = F.regexp_extract(txt, QUARTER_RE, 2)
    ts = F.try_to_timestamp(txt)
    is_q = qy != ""
    year = F.when(is_q, qy.cast("int")).otherwise(F.year(ts))
    quarter = F.when(is_q, qq.cast("int")).otherwise(F.quarter(ts))
    month = F.when(is_q, (qq.cast("int") - 1) * 3 + 1).otherwise(F.month(ts))
    return df.select("*", year.alias("year"), month.alias("month"), quarter.alias("quarter"))


def time_features(df: DataFrame, time_column: str, order_by=None, by=()) -> DataFrame:
    """FE-9: year, month, quarter from a timestamp, a date text or quarter text;
    a running index (per series) when the time cannot be parsed."""
    from tabloom.operators.windows import series_positions
    keys = [by] if isinstance(by, str) else list(by)
    order = [order_by] if isinstance(order_by, str) else list(order_by or [time_column])
    return series_positions(time_parts(df, time_column), order, keys, pos="time_index").drop("_size") \
        .withColumn("time_index", F.col("time_index").cast("int"))
