"""Fault diagnosis (FLT-1..4): fault vs normal, health score, fault patterns.

Population statistics (means, covariance) are single distributed aggregates;
only the d×d covariance matrix (d = number of sensors) is inverted on the
driver, and the resulting Mahalanobis distance is a plain Catalyst expression
evaluated on every row, so scoring is one scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.expressions import OperatorError, numeric_columns, qcol, require_columns
from tabloom.operators.stats import t_test_by_label


PACKED_ROWS = 200_000  # fault rows from which the steps of k-means read packed blocks


def label_flag(df: DataFrame, target: str) -> Column:
    """FLT-1: fault flag from int 1/0, boolean, or 'true'/'false' text; else NULL."""
    require_columns(df, [target])
    t = dict((f.name, f.dataType) for f in df.schema.fields)[target]
    c = qcol(target)
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, T.NumericType):
        return F.when(c == 1, True).when(c == 0, False)
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)


def features_of(df: DataFrame, target: str, features=None):
    return list(features) if features else [c for c in numeric_columns(df) if c != target]


def fault_vs_normal(df: DataFrame, target: str, features=None, top: int = 3):
    """FLT-2: per feature normal/fault means, difference, % of |normal mean|,
    pooled t-test p, significance; returns ``(comparisons, top_k, summary)``."""
    feats = features_of(df, target, features)
    flag = label_flag(df, target)
    t = t_test_by_label(df.withColumn("_flag", flag).filter(F.col("_flag").isNotNull()),
                        F.col("_flag"), feats)
    diff = F.col("mean_fault") - F.col("mean_normal")
    pct = F.when(F.col("mean_normal") != 0, diff / F.abs(F.col("mean_normal")) * 100).otherwise(F.lit(0.0))
    comp = t.select("feature", "mean_normal", "mean_fault", diff.alias("difference"),
                    pct.alias("diff_pct"), "t", "p_value",
                    (F.col("p_value") < 0.05).alias("significant"))
    top_k = comp.orderBy(F.abs("diff_pct").desc(), "feature").limit(top)
    summary = df.agg(F.count(F.lit(1)).alias("total_samples"),
                     F.count_if(flag).alias("fault_samples"),
                     F.count_if(~flag).alias("normal_samples")) \
        .withColumn("fault_rate", F.col("fault_samples") / F.col("total_samples"))
    return comp, top_k, summary


def normal_profile(df: DataFrame, target: str, features=None):
    """Mean vector, std vector and covariance matrix of the normal rows (one agg)."""
    feats = features_of(df, target, features)
    normal = df.filter(label_flag(df, target) == F.lit(False))
    d = len(feats)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(qcol(f).cast("double")).alias(f"m{i}") for i, f in enumerate(feats)]
    aggs += [F.covar_samp(qcol(feats[i]).cast("double"), qcol(feats[j]).cast("double")).alias(f"c{i}_{j}")
             for i in range(d) for j in range(i, d)]
    row = normal.agg(*aggs).first()
    if row["n"] < 2:
        raise OperatorError("fewer than 2 normal rows: cannot score health")
    mean = np.array([row[f"m{i}"] for i in range(d)], dtype=float)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return feats, mean, cov


def health_scorer(baseline: DataFrame, target: str, features=None, z_limit: float = 1.5):
    """FLT-3 with a frozen baseline: fit the normal population on a batch table
    once and return ``score(df)``, a pure projection (no action), so it can be
    applied to streaming DataFrames as well."""
    feats, mean, cov = normal_profile(baseline, target, features)

    def score(df: DataFrame) -> DataFrame:
        return _score(df, target, feats, mean, cov, z_limit)
    return score


def health_score(df: DataFrame, target: str, features=None, z_limit: float = 1.5) -> DataFrame:
    """FLT-3: Mahalanobis distance of every row from the normal population.

    score = clamp(100 − 10·d, 0, 100); risk low ≥ 80, medium ≥ 60, else high;
    ``abnormal_sensors`` lists features with |z| > 1.5 and their % deviation.
    Pick one sample afterwards (e.g. ``last_per_group``) for the reference's
    single-sample form.
    """
    feats, mean, cov = normal_profile(df, target, features)
    return _score(df, target, feats, mean, cov, z_limit)


def _score(df: DataFrame, target: str, feats, mean, cov, z_limit: float) -> DataFrame:
    try:
        inv = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(cov)
    if not np.all(np.isfinite(inv)):
        inv = np.linalg.pinv(cov)
    dev = [qcol(f).cast("double") - F.lit(float(mean[i])) for i, f in enumerate(feats)]
    quad = None
    for i in range(len(feats)):
        for j in range(len(feats)):
            if inv[i, j] == 0:
                continue
            term = dev[i] * dev[j] * F.lit(float(inv[i, j]))
            quad = term if quad is None else quad + term
    dist = F.sqrt(F.greatest(quad if quad is not None else F.lit(0.0), F.lit(0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - dist * 10.0))
    std = np.sqrt(np.diag(cov))
    sensors = []
    for i, f in enumerate(feats):
        if std[i] > 0:
            z = dev[i] / F.lit(float(std[i]))
            pct = F.abs(dev[i] / F.lit(float(mean[i])) * 100) if mean[i] != 0 else F.lit(None).cast("double")
            sensors.append(F.when(F.abs(z) > z_limit, F.struct(F.lit(f).alias("sensor"),
                                                               F.when(z > 0, "high").otherwise("low").alias("direction"),
                                                               pct.alias("deviation_pct"))))
    abnormal = F.filter(F.array(*sensors), lambda s: s.isNotNull()) if sensors else F.array()
    out = df.select("*", dist.alias("mahalanobis_distance"))
    out = out.withColumn("health_score", score)
    return out.withColumn("risk_level", F.when(F.col("health_score") >= 80, "low")
                          .when(F.col("health_score") >= 60, "medium").otherwise("high")) \
        .withColumn("abnormal_sensors", abnormal) \
        .withColumn("actual_failure", label_flag(df, target))


def cluster_profile(assigned: DataFrame, normal_means: dict, cluster_col: str = "cluster",
                    threshold: float = 20.0) -> DataFrame:
    """FLT-4 profile for given cluster assignments of the fault rows.

    Per cluster: size, share, features deviating more than ``threshold`` % from
    the normal mean (top 3), a name from the top 2, severity from the mean of
    the top-3 deviations (> 50 high, > 30 medium, else low; none -> medium).
    """
    feats = list(normal_means)
    per = assigned.groupBy(qcol(cluster_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(qcol(f).cast("double")).alias(f"m{i}") for i, f in enumerate(feats)])
    total = F.sum("count").over(Window.partitionBy())
    per = per.withColumn("pct", F.col("count") * 100.0 / total)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("value"),
                     F.lit(float(normal_means[f])).alias("normal")) for i, f in enumerate(feats)
            if normal_means[f] not in (None, 0)]
    long = per.select("cluster", "count", "pct", F.explode(F.array(*rows)).alias("_r")).select(
        "cluster", "count", "pct", "_r.*")
    dpct = (F.col("value") - F.col("normal")) / F.abs(F.col("normal")) * 100
    sig = long.withColumn("diff_pct", F.abs(dpct)).withColumn("status", F.when(dpct > 0, "high").otherwise("low")) \
        .filter(F.col("diff_pct") > threshold)
    w = Window.partitionBy("cluster").orderBy(F.col("diff_pct").desc(), "feature")
    sig = sig.withColumn("_rk", F.row_number().over(w)).filter("_rk <= 3")
    agg = sig.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct(
            "_rk", F.concat("feature", F.lit("("), "status", F.lit(")")).alias("f")))).alias("_top"),
        F.avg("diff_pct").alias("avg_dev"),
        F.sort_array(F.collect_list(F.when(F.col("_rk") <= 2, F.struct(
            "_rk", F.concat("feature", F.lit(" "), "status").alias("n"))))).alias("_names"))
    out = per.select("cluster", "count", "pct").join(agg, "cluster", "left")
    name = F.when(F.size(F.col("_names")) > 0,
                  F.concat(F.array_join(F.col("_names.n"), "+"), F.lit(" fault"))) \
        .otherwise(F.concat(F.lit("pattern "), (F.col("cluster") + 1).cast("string"), F.lit(" fault")))
    sev = F.when(F.col("avg_dev").isNull(), "medium").when(F.col("avg_dev") > 50, "high") \
        .when(F.col("avg_dev") > 30, "medium").otherwise("low")
    return out.select("cluster", "count", "pct", F.coalesce(F.col("_top.f"), F.array().cast("array<string>"))
                      .alias("top_features"), name.alias("name"), sev.alias("severity"))


def fault_patterns(df: DataFrame, target: str, k: int = 3, features=None, seed: int = 42,
                   n_init: int = 10, max_iter: int = 300) -> DataFrame:
    """FLT-4: k-means over the fault rows (best of ``n_init`` seeded runs by cost),
    then :func:`cluster_profile` against the normal means.

    From ``PACKED_ROWS`` fault rows on, Spark's ``KMeans`` only draws the first centers of
    every run (k-means||); the runs' steps are then made together, one pass per step for
    all runs not yet at rest. Of runs that reach the same clusters rounding picks the
    best, so their numbers may differ between the two plans."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    feats = features_of(df, target, features)
    flag = label_flag(df, target)
    faults = df.filter(flag == F.lit(True))
    n_fault = faults.count()
    if n_fault < k:
        raise OperatorError(f"fault rows ({n_fault}) fewer than clusters ({k})")
    rows = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="skip").transform(faults)
    vec = rows.select("_features").cache()
    packed = n_fault >= PACKED_ROWS
    runs = [KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="cluster", maxIter=0 if packed else max_iter)
            for i in range(n_init)]
    models = [est.fit(vec) for est in runs]
    if packed:
        values = [qcol(f).cast("double") for f in feats]
        vec.unpersist()
        centers = lloyd(rows.select(*values), [np.array(m.clusterCenters()) for m in models], max_iter, runs[0].getTol())
        assigned = rows.drop("_features").withColumn("cluster", nearest_center(values, centers))
    else:
        assigned = min(models, key=lambda m: m.summary.trainingCost).transform(rows).drop("_features")
        vec.unpersist()
    normal = df.filter(flag == F.lit(False)).agg(*[F.avg(qcol(f)).alias(f) for f in feats]).first().asDict()
    return cluster_profile(assigned, normal)


def nearest_center(values: list[Column], centers: np.ndarray) -> Column:
    """Number of the nearest center, of equally near ones the first."""
    far = F.array(*[sum(((v - F.lit(float(c))) * (v - F.lit(float(c))) for v, c in zip(values, center)), F.lit(0.0)) for center in centers])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def _packed(width: int):
    """Rows as binary blocks of one column after the other."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                block = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(width)])
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])
    return run


def _step(centers: dict[int, np.ndarray], width: int):
    """Per run and cluster of a task's blocks: sums, rows, squared distances."""
    def run(batches):
        sums = {i: np.zeros((len(c), width + 2)) for i, c in centers.items()}
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer()).reshape(width, -1)
                for i, c in centers.items():
                    far = np.stack([sum((v - at) ** 2 for v, at in zip(x, center)) for center in c])
                    own = far.argmin(axis=0)
                    cost = far[own, np.arange(len(own))]
                    for j, v in enumerate((*x, None, cost)):
                        sums[i][:, j] += np.bincount(own, v, len(c))
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([s.tobytes()], pa.binary())], names=["run", "sums"])
    return run


def lloyd(rows: DataFrame, starts: list[np.ndarray], max_iter: int, tol: float) -> np.ndarray:
    """Centers of the cheapest run of Lloyd's steps from ``starts``. As in Spark's ``KMeans``
    a run rests when no center moves by more than ``tol``, empty clusters keep their
    center, and the cost is that of the last step. Rows are kept as packed blocks; a task
    returns a few sums per run and cluster."""
    width = len(rows.columns)
    blocks = rows.mapInArrow(_packed(width), "block binary").persist()
    live, done, cost = dict(enumerate(starts)), {}, {}
    for _ in range(max_iter):
        total = {}
        for r in blocks.mapInArrow(_step(dict(live), width), "run long, sums binary").collect():
            total[r.run] = total.get(r.run, 0) + np.frombuffer(r.sums).reshape(-1, width + 2)
        for i, s in total.items():
            n = s[:, width:width + 1]
            new = np.where(n > 0, s[:, :width] / np.maximum(n, 1), live[i])
            cost[i] = s[:, -1].sum()
            if (((new - live[i]) ** 2).sum(axis=1) <= tol * tol).all():
                done[i] = new
                del live[i]
            else:
                live[i] = new
        if not live:
            break
    blocks.unpersist()
    done |= live
    return done[min(done, key=lambda i: (cost.get(i, 0.0), i))]
