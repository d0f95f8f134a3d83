"""Stored sketches of a growing table (AGG-1, AGG-3, DQ-9 beside the exact forms).

Every load of a table is scanned once and leaves small tables that merge by sums
and maxima; statistics of all loads, of some of them or of one come from those,
without a rescan. The parts:

* ``moments``: rows, missing cells, finite numbers, their sum and sum of squares
  about the load's mean, min, max;
* ``buckets``: counts of values by logarithmic bucket, for quantiles. A bucket
  holds (g^(i-1), g^i] with g = (1 + e) / (1 - e), negative values mirrored, zero
  for itself, so that a quantile is within ``e`` times its own size;
* ``registers``: the largest number of leading zeros + 1 of a 64-bit hash per
  register, for distinct counts (standard error 1.04 / sqrt(2^p)).

Counts and maxima do not depend on how rows were dealt to loads: buckets and
registers of merged loads *are* those of the whole table. A load has at most one
bucket row per power of g between the smallest and the largest value (a few
hundred to a few thousand) and 2^p register rows per column. Both aggregates
combine inside tasks first, so a value that fills a third of the rows is one row
per task.

Missing cells are NULL and NaN. Infinite numbers are the outermost buckets and
may be the minimum or maximum; mean and deviation are of the finite numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, as_list, is_numeric, present, qcol, require_columns

ERROR, PRECISION = 0.01, 14
_INF_BUCKET = 1 << 30
_BUCKETS = "column string, bucket int, rows bigint"
_REGISTERS = "column string, register int, level int"
_MOMENTS = "column string, rows bigint, missing bigint, finite bigint, total double, spread double, low double, high double"


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise OperatorError("error must be between 0 and 1")
    return (1 + error) / (1 - error)


def _cells(df: DataFrame, columns) -> DataFrame:
    """One row per cell: column, x (number or NULL), h (hash of the value or NULL)."""
    parts = []
    for c in columns:
        v = present(df, c)
        x = v.cast("double") if is_numeric(df, c) else F.lit(None).cast("double")
        v = v + F.lit(0.0) if dict(df.dtypes)[c] in ("float", "double") else v  # -0.0 is 0.0
        parts.append(F.struct(F.lit(c).alias("column"), x.alias("x"),
                              F.when(v.isNotNull(), F.xxhash64(v)).alias("h")))
    return df.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def _bucket(x, gamma: float):
    """Bucket number by sign and size: ... -2 -1 of negatives, 0, 1 ... of positives,
    offset so that a larger number is a larger value."""
    size = F.when(F.abs(x) == float("inf"), F.lit(_INF_BUCKET)) \
        .otherwise(F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma))).cast("int") + F.lit(_INF_BUCKET // 2))
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def sketch(df: DataFrame, columns=None, error: float = ERROR, precision: int = PRECISION) -> dict:
    """The three sketch tables of ``df`` as lazy DataFrames (one scan each)."""
    cols = as_list(columns) or list(df.columns)
    require_columns(df, cols)
    if not 4 <= precision <= 18:
        raise OperatorError("precision must be between 4 and 18")
    cells = _cells(df, cols)
    gamma = _gamma(error)
    buckets = cells.filter("x IS NOT NULL").groupBy("column", _bucket(F.col("x"), gamma).alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    rest = F.shiftleft("h", precision)
    # bin() writes no leading zeros, and all 64 digits of a negative number.
    level = F.when(rest == 0, F.lit(64 - precision + 1)).otherwise(F.lit(65) - F.length(F.bin(rest)))
    registers = cells.filter("h IS NOT NULL") \
        .groupBy("column", F.shiftrightunsigned("h", 64 - precision).cast("int").alias("register")) \
        .agg(F.max(level).cast("int").alias("level"))
    finite = F.when(F.abs("x") != float("inf"), F.col("x"))
    moments = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("h").isNull()).alias("missing"),
        F.count(finite).alias("finite"), F.sum(finite).alias("total"), (F.var_pop(finite) * F.count(finite)).alias("spread"),
        F.min("x").alias("low"), F.max("x").alias("high"))
    return {"buckets": buckets, "registers": registers, "moments": moments}


def write_load(df: DataFrame, path: str, load: str, columns=None, error: float = ERROR,
               precision: int = PRECISION) -> None:
    """Store the sketches of one load under ``path``. A load that is written again
    replaces itself, so a failed or repeated job does no harm. Loads of one folder
    share ``error`` and ``precision`` (part of the folder names)."""
    if not load or any(ch in load for ch in "/=\\"):
        raise OperatorError("a load needs a plain name")
    for name, table in sketch(df, columns, error, precision).items():
        table.write.mode("overwrite").parquet(f"{path}/{_folder(name, error, precision)}/load={load}")


def _folder(name: str, error: float, precision: int) -> str:
    return {"buckets": f"buckets-{error}", "registers": f"registers-{precision}"}.get(name, name)


def read_loads(spark: SparkSession, path: str, loads=None, error: float = ERROR, precision: int = PRECISION) -> dict:
    """Merged sketches of the stored loads (all, or the named ones)."""
    parts = {}
    for name, schema in (("buckets", _BUCKETS), ("registers", _REGISTERS), ("moments", _MOMENTS)):
        try:
            t = spark.read.schema(schema + ", load string").parquet(f"{path}/{_folder(name, error, precision)}")
        except Exception as e:
            raise OperatorError(f"no stored sketches of these parameters at {path}") from e
        parts[name] = t if loads is None else t.filter(F.col("load").isin([str(x) for x in as_list(loads)]))
    return merge(parts)


def merge(parts: dict) -> dict:
    """Sketch tables with several rows per key, added up. The spread is put together
    about the common mean, without a difference of large sums."""
    m = parts["moments"]
    sums = m.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("rows", "missing", "finite", "total")],
                                   F.min("low").alias("low"), F.max("high").alias("high"))
    off = F.try_divide(F.col("total"), F.col("finite")) - F.col("grand")
    spread = m.join(sums.select("column", F.try_divide("total", "finite").alias("grand")), "column") \
        .groupBy("column").agg(F.sum(F.col("spread") + F.col("finite") * off * off).alias("spread"))
    return {"buckets": parts["buckets"].groupBy("column", "bucket").agg(F.sum("rows").alias("rows")),
            "registers": parts["registers"].groupBy("column", "register").agg(F.max("level").alias("level")),
            "moments": sums.join(spread, "column")}


def sketch_quantiles(merged: dict, probs=(0.25, 0.5, 0.75), error: float = ERROR) -> DataFrame:
    """(column, prob, value): the value at position floor(prob * (n - 1)) of the
    sorted numbers, within ``error`` times its size and inside [min, max]."""
    gamma = _gamma(error)
    probs = [float(p) for p in probs]
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise OperatorError("probs must be between 0 and 1")
    # Bucket rows per column are bounded by the range of doubles, so a window may hold them.
    w = Window.partitionBy("column").orderBy("bucket")
    upto = F.sum("rows").over(w)
    n = F.sum("rows").over(Window.partitionBy("column"))
    at = F.floor(F.col("prob") * (F.col("_n") - 1))
    hit = merged["buckets"].select("column", "bucket", "rows", upto.alias("_upto"), n.alias("_n")) \
        .withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs]))) \
        .filter((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("rows")))
    b = F.col("bucket")
    size = F.when(F.abs(b) == _INF_BUCKET, F.lit(float("inf"))) \
        .otherwise(2 * F.pow(F.lit(gamma), F.abs(b) - F.lit(_INF_BUCKET // 2)) / F.lit(gamma + 1))
    value = F.when(b == 0, F.lit(0.0)).when(b > 0, size).otherwise(-size)
    return hit.join(merged["moments"].select("column", "low", "high"), "column") \
        .select("column", "prob", F.least(F.greatest(value, F.col("low")), F.col("high")).alias("value"))


def sketch_distinct(merged: dict, precision: int = PRECISION) -> DataFrame:
    """(column, distinct): estimated number of different present values, from the
    numbers of registers by level (Ertl's estimator, no bias tables)."""
    m = float(1 << precision)
    held = merged["registers"].groupBy("column").agg(
        F.count(F.lit(1)).alias("_set"), F.sum(F.pow(F.lit(2.0), -F.col("level"))).alias("_sum"))
    x = (F.lit(m) - F.col("_set")) / F.lit(m)  # share of empty registers
    start = F.struct(x.alias("x"), F.lit(1.0).alias("y"), x.alias("z"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, lambda a, _: F.struct(
        (a["x"] * a["x"]).alias("x"), (a["y"] * 2).alias("y"), (a["z"] + a["x"] * a["x"] * a["y"]).alias("z")), lambda a: a["z"])
    found = held.select("column", F.round(m * m / (2 * math.log(2)) / (F.lit(m) * step + F.col("_sum"))).cast("bigint").alias("distinct"))
    return merged["moments"].select("column").join(found, "column", "left") \
        .select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def describe_sketch(merged: dict, error: float = ERROR, precision: int = PRECISION) -> DataFrame:
    """AGG-1 / AGG-3 from sketches: one row per column with count, missing, distinct
    (estimate), mean, std (n-1), min, q25, q50, q75 (within ``error``), max."""
    q = sketch_quantiles(merged, error=error).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    held = merged["moments"].join(sketch_distinct(merged, precision), "column").join(q, "column", "left")
    return held.select(
        "column", (F.col("rows") - F.col("missing")).alias("count"), "missing", "distinct",
        F.try_divide("total", "finite").alias("mean"), F.sqrt(F.try_divide(F.col("spread"), F.col("finite") - 1)).alias("std"),
        F.col("low").alias("min"), "q25", "q50", "q75", F.col("high").alias("max"))
