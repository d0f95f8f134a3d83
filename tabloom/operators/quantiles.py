"""Exact quantiles (linear interpolation, as pandas / ``quantile_cont``).

Spark's exact ``percentile`` aggregate merges one value->count map per column
in a single task, which holds every distinct value of the column. Up to
``GLOBAL_LIMIT`` rows that is the fastest plan; above it the quantiles are
found without gathering the column:

1. approximate quantile boundaries (``percentile_approx``, a bounded sketch)
   cut the value range into B buckets of about equal row counts;
2. ``Bucketizer`` (JVM binary search) tags each row with its bucket and
   ``groupBy(bucket, value).count`` collapses duplicates, distributed;
3. bucket totals (B rows) give every bucket's global row offset;
4. a running count inside each bucket (a window partitioned by bucket, so no
   task sees more than one bucket) locates the rows at the wanted positions.

The boundaries are literals computed once, so retries recompute the same
buckets (no partition-id dependence, no checkpoint needed).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import null_safe_join, qcol

GLOBAL_LIMIT = 5_000_000
ROWS_PER_BUCKET = 2_000_000


def distributed_quantiles(df: DataFrame, columns, probs) -> dict:
    """Exact quantiles of several columns in three jobs (see module doc).

    All columns are stacked as (column id, bucket, value) so the boundaries,
    the value counts and the final lookup are one job each whatever the
    number of columns. The (small, distinct-value) count table is cached
    between the two jobs that read it.
    """
    from pyspark.ml.feature import Bucketizer
    cols = list(columns)
    probs = list(probs)
    vals = [qcol(c).cast("double") for c in cols]
    ok = [F.when(~F.isnan(v), v) for v in vals]
    n_rows = df.agg(*[F.count(o).alias(f"n{i}") for i, o in enumerate(ok)]).first()
    ns = [n_rows[f"n{i}"] for i in range(len(cols))]
    bs = [max(16, math.ceil(max(n, 1) / ROWS_PER_BUCKET)) for n in ns]
    cut_row = df.agg(*[F.percentile_approx(o, [j / b for j in range(1, b)], 10 * b).alias(f"q{i}")
                       for i, (o, b) in enumerate(zip(ok, bs))]).first()
    splits = [[-math.inf] + sorted(set(float(x) for x in (cut_row[f"q{i}"] or []))) + [math.inf]
              for i in range(len(cols))]
    wide = df.select(*[o.alias(f"_v{i}") for i, o in enumerate(ok)])
    wide = Bucketizer(splitsArray=splits, inputCols=[f"_v{i}" for i in range(len(cols))],
                      outputCols=[f"_b{i}" for i in range(len(cols))], handleInvalid="keep").transform(wide)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_b{i}").alias("_b"), F.col(f"_v{i}").alias("_v"))
        for i in range(len(cols))])).alias("_s")).select("_s.*").filter(F.col("_v").isNotNull())
    counts = stacked.groupBy("_i", "_b", "_v").agg(F.count(F.lit(1)).alias("_c")).cache()
    try:
        totals = counts.groupBy("_i", "_b").agg(F.sum("_c").alias("_t")).collect()
        per = {}
        for r in totals:
            per.setdefault(r["_i"], []).append((r["_b"], r["_t"]))
        wanted = []
        for i in range(len(cols)):
            n = ns[i]
            if not n:
                continue
            offs, acc = [], 0
            for bucket, t in sorted(per.get(i, [])):
                offs.append((bucket, acc, t))
                acc += t
            for p in probs:
                x = p * (n - 1)
                for k in {math.floor(x), math.ceil(x)}:
                    for bucket, off, t in offs:
                        if off <= k < off + t:
                            wanted.append((i, float(bucket), int(k - off), int(k)))
        at = {}
        if wanted:
            targets = df.sparkSession.createDataFrame(wanted, "_i int, _b double, _lk long, _k long")
            w = Window.partitionBy("_i", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            located = counts.join(F.broadcast(targets.select("_i", "_b").distinct()), ["_i", "_b"]) \
                .withColumn("_cum", F.sum("_c").over(w)) \
                .join(F.broadcast(targets), ["_i", "_b"]) \
                .filter((F.col("_cum") - F.col("_c") <= F.col("_lk")) & (F.col("_lk") < F.col("_cum"))) \
                .select("_i", "_k", "_v").collect()
            at = {(r["_i"], r["_k"]): r["_v"] for r in located}
    finally:
        counts.unpersist()
    out = {}
    for i, c in enumerate(cols):
        n = ns[i]
        res = []
        for p in probs:
            if not n:
                res.append(None)
                continue
            x = p * (n - 1)
            lo, hi = math.floor(x), math.ceil(x)
            res.append(at[(i, lo)] + (at[(i, hi)] - at[(i, lo)]) * (x - lo))
        out[c] = res
    return out


def quantiles(df: DataFrame, columns, probs, mode: str = "auto", approx: bool = False,
              n_rows: int | None = None) -> dict:
    """{column: [quantile per prob]} with linear interpolation.

    mode ``global``: one fused ``percentile`` aggregate; ``distributed``: the
    bucketed plan above; ``auto``: global up to ``GLOBAL_LIMIT`` rows.
    ``approx=True`` uses ``percentile_approx`` (bounded memory, approximate).
    """
    cols = list(columns)
    probs = list(probs)
    if approx:
        row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), probs, 10000).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    if mode == "auto":
        n = df.count() if n_rows is None else n_rows
        mode = "global" if n <= GLOBAL_LIMIT else "distributed"
    if mode == "global":
        row = df.agg(*[F.percentile(F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")), probs)
                       .alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                for i, c in enumerate(cols)}
    return distributed_quantiles(df, cols, probs)


# Rows of one group that the exact per-group ``percentile`` may merge in one task.
GROUP_LIMIT = 5_000_000


def group_quantiles(df: DataFrame, by, column: str, probs, names, mode: str = "auto",
                    group_limit: int | None = None) -> DataFrame:
    """Exact per-group quantiles (linear interpolation): ``by`` + one column per prob.

    ``auto`` checks the largest group: if no group exceeds ``group_limit``
    rows, one ``groupBy(...).agg(percentile)`` is used. Otherwise every group
    goes through the bucketed plan: groups above the limit (at most
    rows / limit of them, collected) get approximate value boundaries, rows are
    tagged with their (group, bucket), duplicates are counted, bucket offsets
    come from a scan over at most B rows per group, and a running count inside
    the target buckets picks the values at the wanted positions. No task holds
    more than one bucket of a hot group.
    """
    keys = [by] if isinstance(by, str) else list(by)
    probs, names = list(probs), list(names)
    limit = GROUP_LIMIT if group_limit is None else group_limit
    k = [qcol(x) for x in keys]
    v = qcol(column).cast("double")
    clean = df.select(*k, F.when(~F.isnan(v), v).alias("__tb_v")).filter(F.col("__tb_v").isNotNull())
    sizes = clean.groupBy(*k).agg(F.count(F.lit(1)).alias("__tb_n"))
    if mode == "auto":
        largest = sizes.agg(F.max("__tb_n")).first()[0] or 0
        mode = "global" if largest <= limit else "distributed"
    if mode == "global":
        q = clean.groupBy(*k).agg(F.percentile("__tb_v", probs).alias("_q"))
        return q.select(*k, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    large = sizes.filter(F.col("__tb_n") > limit)
    largest = large.agg(F.max("__tb_n")).first()[0] or 0
    b = max(16, math.ceil(largest / ROWS_PER_BUCKET))
    cuts = null_safe_join(clean, large.select(*k), keys, "inner") \
        .groupBy(*k).agg(F.percentile_approx("__tb_v", [j / b for j in range(1, b)], 10 * b).alias("__tb_cuts"))
    # one row per large group; the join is left to the measured size
    tagged = null_safe_join(clean, cuts, keys, "left") \
        .withColumn("__tb_b", F.size(F.filter(F.coalesce(F.col("__tb_cuts"), F.array().cast("array<double>")),
                                          lambda x: x < F.col("__tb_v")))).drop("__tb_cuts")
    counts = tagged.groupBy(*k, "__tb_b", "__tb_v").agg(F.count(F.lit(1)).alias("__tb_c"))
    totals = counts.groupBy(*k, "__tb_b").agg(F.sum("__tb_c").alias("__tb_t"))
    w_off = Window.partitionBy(*k).orderBy("__tb_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__tb_off", F.coalesce(F.sum("__tb_t").over(w_off), F.lit(0))) \
        .transform(lambda d: null_safe_join(d, sizes, keys, "inner"))
    # wanted positions (lo and hi of each prob) that fall inside each bucket
    pos = []
    for j, p in enumerate(probs):
        x = F.lit(float(p)) * (F.col("__tb_n") - 1)
        for side, kk in (("lo", F.floor(x)), ("hi", F.ceil(x))):
            pos.append(F.struct(F.lit(j).alias("__tb_j"), F.lit(side).alias("__tb_side"), kk.cast("long").alias("__tb_k")))
    targets = offsets.select(*k, "__tb_b", "__tb_off", "__tb_t", F.explode(F.array(*pos)).alias("__tb_p")) \
        .select(*k, "__tb_b", "__tb_off", "__tb_t", "__tb_p.*") \
        .filter((F.col("__tb_k") >= F.col("__tb_off")) & (F.col("__tb_k") < F.col("__tb_off") + F.col("__tb_t"))) \
        .withColumn("__tb_lk", F.col("__tb_k") - F.col("__tb_off"))
    w = Window.partitionBy(*k, "__tb_b").orderBy("__tb_v").rowsBetween(Window.unboundedPreceding, 0)
    need = targets.select(*k, "__tb_b").distinct()
    located = null_safe_join(counts, need, keys + ["__tb_b"], "inner").withColumn("__tb_cum", F.sum("__tb_c").over(w))
    located = null_safe_join(located, targets.select(*k, "__tb_b", "__tb_j", "__tb_side", "__tb_lk"), keys + ["__tb_b"], "inner") \
        .filter((F.col("__tb_cum") - F.col("__tb_c") <= F.col("__tb_lk")) & (F.col("__tb_lk") < F.col("__tb_cum")))
    picked = located.groupBy(*k).agg(*[
        F.max(F.when((F.col("__tb_j") == j) & (F.col("__tb_side") == s), F.col("__tb_v"))).alias(f"_{s}{j}")
        for j in range(len(probs)) for s in ("lo", "hi")])
    res = null_safe_join(picked, sizes, keys, "inner")
    out = []
    for j, (p, n) in enumerate(zip(probs, names)):
        x = F.lit(float(p)) * (F.col("__tb_n") - 1)
        frac = x - F.floor(x)
        out.append((F.col(f"_lo{j}") + (F.col(f"_hi{j}") - F.col(f"_lo{j}")) * frac).alias(n))
    return res.select(*k, *out)
