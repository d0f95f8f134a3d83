"""Data-quality issues, score and report (DQ-1..11).

One fused aggregate gathers every per-column counter (missing, numeric-looking
text share); quartiles come from :func:`tabloom.operators.quantiles.quantiles`
(exact, distributed on large tables); a second fused aggregate counts outliers
against those bounds; duplicates are one ``groupBy`` over all columns. Only
counters and bounds (a few numbers per column) pass through the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.profile import unique_counts
from tabloom.functions.expressions import is_missing, normalise_nan, numeric_columns, qcol, string_columns

# Value patterns recognised by the profile (anchored regexes).
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[1-9]?\d{1,14}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "numeric": r"^-?\d+\.?\d*$",
}

# Severity penalties of the quality score.
PENALTY = {"high": 20, "medium": 10, "low": 5}

_ISSUE_SCHEMA = ("type string, column string, severity string, count long, rate double, "
                 "lower double, upper double, suggestion string")


def name_issues(columns) -> list[tuple]:
    """DQ-2: names with spaces, characters outside word/CJK, or > 50 chars."""
    out = []
    for c in columns:
        reasons = []
        if " " in c:
            reasons.append("contains space")
        if re.search(r"[^\w一-鿿]", c):
            reasons.append("special characters")
        if len(c) > 50:
            reasons.append("too long")
        if reasons:
            out.append(("column_name", c, "low", None, None, None, None, "; ".join(reasons)))
    return out


def _severity(rate):
    return F.when(rate > 0.5, "high").when(rate > 0.1, "medium").otherwise("low")


@dataclass
class Counters:
    """What one scan of the table tells: rows, missing cells, texts and numbers in texts."""
    rows: int
    missing: dict
    texts: dict
    numeric_texts: dict


def counters(df: DataFrame) -> Counters:
    """All per-column counters of issues, score and report in one aggregate."""
    cols, strs = list(df.columns), string_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.count(qcol(c)).alias(f"t{i}") for i, c in enumerate(strs)]
    aggs += [F.count_if(qcol(c).rlike(PATTERNS["numeric"])).alias(f"k{i}") for i, c in enumerate(strs)]
    row = df.agg(*aggs).first()
    return Counters(row["rows"], {c: row[f"m{i}"] for i, c in enumerate(cols)},
                    {c: row[f"t{i}"] for i, c in enumerate(strs)}, {c: row[f"k{i}"] for i, c in enumerate(strs)})


def quality_issues(df: DataFrame, approx: bool = False) -> DataFrame:
    """DQ-1: union of name, missing, duplicate, type and outlier issues."""
    found = counters(df)
    return df.sparkSession.createDataFrame(_issues(df, found, duplicate_rows(df), approx), _ISSUE_SCHEMA)


def _issues(df: DataFrame, found: Counters, duplicates: int, approx: bool) -> list[tuple]:
    """Issue rows from the counters, the duplicates and one pass each for the
    quartiles and the values beyond them."""
    from tabloom.operators.quantiles import quantiles
    rows, nums = found.rows, numeric_columns(df)
    issues = name_issues(df.columns)
    for c, m in found.missing.items():
        if m and rows:
            rate = m / rows
            sev = "high" if rate > 0.5 else "medium" if rate > 0.1 else "low"
            issues.append(("missing_values", c, sev, int(m), float(rate), None, None, "fill median"))
    if duplicates > 0:
        issues.append(("duplicate_rows", None, "medium", int(duplicates), float(duplicates / rows), None, None,
                       "drop duplicates keep first"))
    for c, n in found.texts.items():
        if n and found.numeric_texts[c] / n > 0.8:
            issues.append(("data_type", c, "medium", int(found.numeric_texts[c]), float(found.numeric_texts[c] / n),
                           None, None, "numeric"))
    values = normalise_nan(df.select(*[qcol(c) for c in nums])) if nums else None
    quart = quantiles(values, nums, [0.25, 0.75], approx=approx, n_rows=rows) if nums else {}
    bounds = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quart.items() if q[0] is not None}
    if bounds:
        oc = values.agg(*[F.count_if((qcol(c) < F.lit(lo)) | (qcol(c) > F.lit(hi))).alias(f"o{i}")
                          for i, (c, (lo, hi)) in enumerate(bounds.items())]).first()
        for i, (c, (lo, hi)) in enumerate(bounds.items()):
            if oc[f"o{i}"] > 0:
                issues.append(("outliers", c, "low", int(oc[f"o{i}"]), float(oc[f"o{i}"] / rows),
                               float(lo), float(hi), "clip"))
    return issues


def duplicate_rows(df: DataFrame) -> int:
    """Rows after the first of each distinct row. Rows meet by a 128-bit hash (with
    the places of their NULLs), so 16 bytes a row are shuffled whatever the width."""
    cells = [x for c in df.columns for x in (qcol(c), qcol(c).isNull())]
    keys = [F.xxhash64(F.lit(seed), *cells).alias(f"h{seed}") for seed in (1, 2)]
    return df.select(*keys).groupBy("h1", "h2").count() \
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def missing_issue_table(df: DataFrame) -> DataFrame:
    """DQ-3 alone, fully lazy: (column, count, rate, severity) for columns with gaps."""
    cols = list(df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("count")) for i, c in enumerate(cols)]
    long = wide.select("_rows", F.explode(F.array(*rows)).alias("_r")).select("_rows", "_r.*") \
        .filter(F.col("count") > 0)
    rate = F.col("count") / F.col("_rows")
    return long.select("column", "count", rate.alias("rate"), _severity(rate).alias("severity"))


def numeric_text_share(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """DQ-5: share of non-null text values that look numeric, flagged > threshold."""
    strs = string_columns(df)
    wide = df.agg(*[F.count(qcol(c)).alias(f"nn{i}") for i, c in enumerate(strs)],
                  *[F.count_if(qcol(c).rlike(PATTERNS["numeric"])).alias(f"k{i}") for i, c in enumerate(strs)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"nn{i}").alias("non_null"),
                     F.col(f"k{i}").alias("numeric_like")) for i, c in enumerate(strs)]
    long = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    share = F.when(F.col("non_null") > 0, F.col("numeric_like") / F.col("non_null"))
    return long.withColumn("share", share).withColumn("should_be_numeric",
                                                      F.coalesce(F.col("share") > threshold, F.lit(False)))


def pattern_profile(df: DataFrame, columns=None) -> DataFrame:
    """DQ-7: share of non-null values matching each fixed pattern, per text column."""
    strs = list(columns) if columns else string_columns(df)
    names = list(PATTERNS)
    aggs = [F.count(qcol(c)).alias(f"nn{i}") for i, c in enumerate(strs)]
    aggs += [F.count_if(qcol(c).rlike(PATTERNS[p])).alias(f"k{i}_{j}")
             for i, c in enumerate(strs) for j, p in enumerate(names)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"),
                     F.when(F.col(f"nn{i}") > 0, F.col(f"k{i}_{j}") / F.col(f"nn{i}")).alias("share"))
            for i, c in enumerate(strs) for j, p in enumerate(names)]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def quality_score(issues: DataFrame) -> DataFrame:
    """DQ-8: 100 − 20·high − 10·medium − 5·low, floored at 0."""
    pen = F.when(F.col("severity") == "high", PENALTY["high"]) \
        .when(F.col("severity") == "medium", PENALTY["medium"]).otherwise(PENALTY["low"])
    return issues.agg(F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(pen), F.lit(0)))
                      .cast("double").alias("score"))


def quality_report(df: DataFrame) -> DataFrame:
    """DQ-9: score, rows, columns, missing cells, duplicate rows, issue count."""
    found, dup = counters(df), duplicate_rows(df)
    issues = _issues(df, found, dup, approx=False)
    score = max(0, 100 - sum(PENALTY.get(i[2], PENALTY["low"]) for i in issues))
    return df.sparkSession.createDataFrame(
        [(float(score), int(found.rows), len(df.columns), int(sum(found.missing.values())), int(dup), len(issues))],
        "score double, rows long, columns long, missing_cells long, duplicate_rows long, issues long")


def summarize_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """DQ-10: per issue type, the number of issues and the top-k columns by count."""
    w = Window.partitionBy("type").orderBy(F.col("count").desc_nulls_last(), F.col("column"))
    ranked = issues.withColumn("_rk", F.row_number().over(w))
    return ranked.groupBy("type").agg(
        F.count(F.lit(1)).alias("issues"),
        F.sort_array(F.collect_list(F.when(F.col("_rk") <= k, F.struct("_rk", "column")))).alias("_top")) \
        .select("type", "issues", F.col("_top.column").alias("top_columns"))


def field_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """DQ-11: dtype, null count, distinct count and the smallest distinct values.

    Missing cells come from one aggregate and distinct counts from one stacked
    value table. Spark tables have no first rows, so the samples are the
    smallest values: a bounded top-k over distinct values of each column.
    """
    cols = list(df.columns)
    dtypes = dict(df.dtypes)
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                     F.col(f"n{i}").alias("null_count")) for i, c in enumerate(cols)]
    counted = unique_counts(df, cols).withColumnRenamed("unique_count", "distinct_count")
    prof = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*").join(counted, "column")
    spark = df.sparkSession
    sample_rows = []
    for c in cols:
        vals = [r[0] for r in df.select(qcol(c)).where(qcol(c).isNotNull()).distinct()
                .orderBy(qcol(c)).limit(samples).collect()]
        sample_rows.append((c, [str(v) for v in vals]))
    samp = spark.createDataFrame(sample_rows, "column string, samples array<string>")
    return prof.join(F.broadcast(samp), "column")
