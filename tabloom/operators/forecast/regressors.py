"""Tree-ensemble forecasts on calendar features (FCT-13, FCT-14, FCT-16).

One global model serves all series: features are year, month, quarter, the
running time index and the series index, so training is a normal distributed
``pyspark.ml`` fit instead of one small fit per series. Candidates of the
parameter grid that differ only in the number of trees share one fit: the
ensemble with most trees is fitted and its first k trees are judged as the
candidate with k trees. The other fits run concurrently, each in parallel
itself; the best candidate is chosen by test MAPE.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import (OperatorError, as_list as _as_list, is_numeric, present, qcol,
                                           require_columns)
from tabloom.operators.forecast.metrics import metric_exprs
from tabloom.operators.windows import series_positions

FEATURES = ["year", "month", "quarter", "time_index", "series_index"]
# Search spaces (tree depth ends at 30, the limit of Spark's trees).
RF_GRID = {"numTrees": list(range(5, 101, 5)), "maxDepth": list(range(5, 31, 5))}
GBT_GRID = {"maxIter": [50, 100, 200, 300], "maxDepth": [3, 5, 7, 9], "stepSize": [0.01, 0.05, 0.1, 0.2]}


def calendar_frame(df: DataFrame, target: str, time_column: str, keys, test_size: float,
                   feature_columns=()) -> DataFrame:
    """One row per period with a target value: calendar features, position in the
    series (block-split on large tables) and the given numeric columns."""
    known = df.filter(present(df, target).isNotNull())
    placed = series_positions(known, time_column, keys, pos="__tb_pos", size="__tb_size")
    t = qcol(time_column)
    base = placed.select(*[qcol(k) for k in keys], t.alias("time"), qcol(target).cast("double").alias("label"),
                         F.year(t).cast("double").alias("year"), F.month(t).cast("double").alias("month"),
                         F.quarter(t).cast("double").alias("quarter"),
                         F.col("__tb_pos").cast("double").alias("time_index"),
                         *[qcol(c).cast("double").alias(c) for c in feature_columns],
                         F.floor(F.col("__tb_size") * F.lit(1.0 - test_size)).alias("_n_train"))
    # series id as a stable numeric code (hash), so no global ranking of series is needed
    sid = F.pmod(F.xxhash64(*[qcol(k) for k in keys]), F.lit(1 << 31)).cast("double") if keys else F.lit(0.0)
    base = base.withColumn("series_index", sid)
    return base.withColumn("is_test", F.col("time_index") > F.col("_n_train")).drop("_n_train")


def _prefix_predictions(model, data: DataFrame, sizes, boosted: bool) -> DataFrame:
    """Add ``__tb_p{k}`` for k in ``sizes``: the prediction of the first k trees."""
    trees = model.trees[:max(sizes)]
    weights = list(model.treeWeights)[:len(trees)] if boosted else [1.0] * len(trees)
    out = data
    for i, tree in enumerate(trees):
        out = tree.setFeaturesCol("features").setPredictionCol(f"__tb_t{i}").transform(out)
    each = F.array(*[F.col(f"__tb_t{i}") * F.lit(float(w)) for i, w in enumerate(weights)])
    out = out.select(*data.columns, each.alias("__tb_e"))

    def first(k):
        total = F.aggregate(F.slice("__tb_e", 1, k), F.lit(0.0), lambda acc, x: acc + x)
        return total if boosted else total / F.lit(float(k))

    return out.select(*data.columns, *[first(k).alias(f"__tb_p{k}") for k in sizes])


def tree_forecast(df: DataFrame, target: str, time_column: str = "time", series_keys=(),
                  model: str = "random_forest", grid: dict | None = None, test_size: float = 0.2,
                  seed: int = 42, extra_periods: int = 0, feature_columns=(), parallelism: int = 4):
    """FCT-13 (random_forest) / FCT-14 (boosted_trees).

    Returns ``(candidates, forecasts, importances)``: test metrics per grid
    point (``best`` flags the winner), test-period predictions of the best
    model (plus ``extra_periods`` future months per series), and the best
    model's feature importances. ``feature_columns`` are further numeric columns;
    future periods take a series' last values of them.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    keys, extra = _as_list(series_keys), _as_list(feature_columns)
    require_columns(df, keys + extra + [target, time_column])
    if bad := [c for c in extra if not is_numeric(df, c)]:
        raise OperatorError(f"non-numeric feature columns: {bad}")
    if model == "random_forest":
        est, g, size = RandomForestRegressor(seed=seed, labelCol="label"), grid or RF_GRID, "numTrees"
    elif model == "boosted_trees":
        est, g, size = GBTRegressor(seed=seed, labelCol="label"), grid or GBT_GRID, "maxIter"
    else:
        raise OperatorError(f"unknown model {model!r}")
    frame = calendar_frame(df, target, time_column, keys, test_size, extra)
    va = VectorAssembler(inputCols=FEATURES + extra, outputCol="features", handleInvalid="skip")
    data = va.transform(frame).cache()
    train, test = data.filter(~F.col("is_test")), data.filter("is_test")
    sizes = sorted(g.get(size, [est.getOrDefault(size)]))
    others = [k for k in g if k != size]

    def fit(combo):
        """One fit judges every number of trees."""
        params = dict(zip(others, combo))
        m = est.copy().setParams(**params, **{size: max(sizes)}).fit(train)
        judged = _prefix_predictions(m, test, sizes, model == "boosted_trees")
        row = judged.agg(*[F.struct(*metric_exprs(F.col("label"), F.col(f"__tb_p{k}"), zero="skip")).alias(f"m{k}")
                           for k in sizes]).first()
        return [({size: k, **params}, row[f"m{k}"], m) for k in sizes]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        found = [c for cs in pool.map(fit, itertools.product(*[g[k] for k in others])) for c in cs]
    spark = df.sparkSession
    results = [(i, str(p), m["mape"], m["mae"], m["rmse"], m["r2"]) for i, (p, m, _) in enumerate(found)]
    cands = spark.createDataFrame(results, "candidate long, params string, mape double, mae double, "
                                           "rmse double, r2 double")
    best_i = min(range(len(results)), key=lambda i: (float("inf") if results[i][2] is None else results[i][2], i))
    cands = cands.withColumn("best", F.col("candidate") == best_i)
    best, k = found[best_i][2], found[best_i][0][size]

    def predicted(rows):
        return _prefix_predictions(best, rows, [k], model == "boosted_trees").withColumnRenamed(f"__tb_p{k}", "prediction")

    fc = predicted(test).select(*keys, "time", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    if extra_periods > 0:
        last = frame.groupBy(*keys, "series_index").agg(F.max("time").alias("_t"), F.max("time_index").alias("_i"),
                                                        *[F.max_by(c, "time_index").alias(c) for c in extra])
        fut = last.select(*keys, "series_index", "_t", "_i", *extra,
                          F.explode(F.sequence(F.lit(1), F.lit(int(extra_periods)))).alias("step"))
        nt = F.add_months(F.col("_t"), F.col("step")).cast("timestamp")
        fut = fut.select(*keys, "series_index", nt.alias("time"), *extra,
                         F.year(nt).cast("double").alias("year"), F.month(nt).cast("double").alias("month"),
                         F.quarter(nt).cast("double").alias("quarter"),
                         (F.col("_i") + F.col("step")).cast("double").alias("time_index"))
        fut = predicted(va.transform(fut)).select(*keys, "time", F.lit(None).cast("double").alias("actual"),
                                                       F.col("prediction").alias("predicted"))
        fc = fc.unionByName(fut.withColumn("time", F.col("time").cast(fc.schema["time"].dataType)))
    imp = spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES + extra, best.featureImportances.toArray())],
                                "feature string, importance double")
    data.unpersist()
    return cands, fc, imp
