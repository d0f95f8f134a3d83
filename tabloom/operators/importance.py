"""Feature importance and feature selection (FSC-1..5, FSL-1..5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, qcol, row_hash
from tabloom.operators import cells
from tabloom.operators import stats as st
from tabloom.operators.knn_information import mutual_info_knn
from tabloom.operators.ml import build_pipeline, classification_metrics, make_estimator, regression_metrics
from tabloom.operators.sampling import kfold, train_test_split
from tabloom.operators.windows import numbered
from tabloom.session import cut_lineage


def _task(df: DataFrame, target: str, task: str | None) -> str:
    return task or st.detect_task(df, target)


def _table(spark, feats, imp, std=None) -> DataFrame:
    rows = [(f, float(v), None if std is None else float(s))
            for f, v, s in zip(feats, imp, std if std is not None else [None] * len(feats))]
    t = spark.createDataFrame(rows, "feature string, importance double, std double")
    return with_percent(t)


def with_percent(t: DataFrame, col: str = "importance") -> DataFrame:
    """FSC-5 + SRT-4: share of the total and rank by importance (tiny table)."""
    w = Window.partitionBy()
    r = Window.orderBy(F.col(col).desc(), "feature")
    return t.withColumn("percent", F.when(F.sum(col).over(w) != 0, F.col(col) / F.sum(col).over(w) * 100)) \
        .withColumn("rank", F.row_number().over(r))


def _fit(df, feats, target, model_type, task, params=None, seed=42):
    return build_pipeline(model_type, feats, target, task, params, seed, df.count()).fit(df)


def rf_importance(df: DataFrame, features, target: str, task: str | None = None, n_trees: int = 100,
                  seed: int = 42) -> DataFrame:
    """FSC-1: forest importances, with the std over the individual trees."""
    feats = list(features)
    task = _task(df, target, task)
    mt = "random_forest_regressor" if task == "regression" else "random_forest_classifier"
    model = _fit(df, feats, target, mt, task, {"n_estimators": n_trees}, seed).stages[-1]
    imp = model.featureImportances.toArray()
    per_tree = np.array([t.featureImportances.toArray() for t in model.trees])
    return _table(df.sparkSession, feats, imp, per_tree.std(axis=0))


def boosted_importance(df: DataFrame, features, target: str, task: str | None = None, seed: int = 42,
                       params: dict | None = None):
    """FSC-4: boosted-tree importances."""
    feats = list(features)
    task = _task(df, target, task)
    mt = "xgboost_regressor" if task == "regression" else "xgboost_classifier"
    model = _fit(df, feats, target, mt, task, params, seed).stages[-1]
    return _table(df.sparkSession, feats, model.featureImportances.toArray())


def linear_importance(df: DataFrame, features, target: str, task: str | None = None, alpha: float = 1.0,
                      C: float = 1.0) -> DataFrame:
    """FSC-3: |coefficient| on standardised features (ridge α / L2 logistic C;
    mean |coef| over classes)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    feats = list(features)
    task = _task(df, target, task)
    n = df.count()
    stages = [VectorAssembler(inputCols=feats, outputCol="_raw", handleInvalid="skip"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]
    if task == "regression":
        stages.append(LinearRegression(labelCol=target, regParam=alpha / n, elasticNetParam=0.0,
                                       standardization=False))
    else:
        stages.insert(0, StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"))
        stages.append(LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                                         maxIter=1000))
    m = Pipeline(stages=stages).fit(df).stages[-1]
    if task == "regression":
        coef = np.abs(m.coefficients.toArray())
    else:
        coef = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    return _table(df.sparkSession, feats, coef)


def permute_column(df: DataFrame, column: str, seed: int, key=None) -> DataFrame:
    """Shuffle one column over all rows: the rows in the order of one hash get the
    values in the order of another one. Both orders are range sorts numbered by
    their partitions' row counts; nothing is sorted in one task."""
    cols = [key] if isinstance(key, str) else (list(key) if key else df.columns)
    rows = numbered(df.drop(column), [row_hash([c for c in cols if c != column] or [F.lit(0)], seed)], "__tb_r")
    vals = numbered(df.select(*[qcol(c) for c in dict.fromkeys([*cols, column])]), [row_hash(cols, seed + 7919)], "__tb_r")
    return rows.join(vals.select("__tb_r", qcol(column)), "__tb_r").drop("__tb_r")


def permutation_importance(df: DataFrame, features, target: str, task: str | None = None,
                           model_type: str | None = None, repeats: int = 10, seed: int = 42,
                           test_size: float = 0.2, key=None) -> DataFrame:
    """FSC-2: drop of R² (regression) or accuracy (classification) on the
    held-out part when a feature is shuffled; mean and std over repeats."""
    feats = list(features)
    task = _task(df, target, task)
    mt = model_type or ("random_forest_regressor" if task == "regression" else "random_forest_classifier")
    split = train_test_split(df, test_size, seed, key)
    train, test = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    model = _fit(train, feats, target, mt, task, None, seed)
    test = cut_lineage(test)  # read for every feature and repeat, the split is not computed again

    def score(d):
        pred = model.transform(d)
        if task == "regression":
            return regression_metrics(pred, target, "prediction").first()["r2"]
        return classification_metrics(pred, "label", "prediction").first()["accuracy"]

    base = score(test)
    imp, std = [], []
    for f in feats:
        drops = [base - score(permute_column(test, f, seed + r, key=key)) for r in range(repeats)]
        imp.append(float(np.mean(drops)))
        std.append(float(np.std(drops)))
    return _table(df.sparkSession, feats, imp, std)


def feature_importance(df: DataFrame, features, target: str, method: str = "rf_importance", **kw) -> DataFrame:
    fns = {"rf_importance": rf_importance, "permutation": permutation_importance,
           "linear_model": linear_importance, "xgboost": boosted_importance}
    if method not in fns:
        raise OperatorError(f"unknown method {method!r}; use one of {sorted(fns)}")
    return fns[method](df, features, target, **kw)


# --------------------------------------------------------------------------
# FSL
# --------------------------------------------------------------------------


def _pick(scores: DataFrame, k: int | None, threshold: float | None, n: int) -> DataFrame:
    """FSL-5: k best, or score ≥ threshold, or the top half by default."""
    r = Window.orderBy(F.col("score").desc_nulls_last(), "feature")
    ranked = scores.withColumn("rank", F.row_number().over(r))
    if threshold is not None:
        sel = F.col("score") >= F.lit(float(threshold))
    else:
        kk = k if k is not None else max(1, n // 2)
        sel = F.col("rank") <= kk
    return ranked.withColumn("selected", F.coalesce(sel, F.lit(False)))


def select_features(df: DataFrame, features, target: str, method: str = "f_regression", k: int | None = None,
                    threshold: float | None = None, task: str | None = None, n_features: int | None = None,
                    cv: int = 3, seed: int = 42, n_trees: int = 100) -> DataFrame:
    """FSL-1..5 and STA-7..9 selectors; returns (feature, score, rank, selected)."""
    feats = list(features)
    n = len(feats)
    if method == "f_regression":
        return _pick(st.f_regression(df, feats, target).select("feature", "score"), k, threshold, n)
    if method == "chi2":
        return _pick(st.chi2_scores(df, feats, target).select("feature", "score"), k, threshold, n)
    if method == "mutual_info":
        cls = _task(df, target, task) == "classification"
        return _pick(st.mutual_info(df, feats, target, classification=cls), k, threshold, n)
    if method == "mutual_info_knn":
        cls = _task(df, target, task) == "classification"
        return _pick(mutual_info_knn(df, feats, target, cls, seed=seed), k, threshold, n)
    if method == "rf_importance":
        imp = rf_importance(df, feats, target, task, n_trees=n_trees, seed=seed) \
            .select("feature", F.col("importance").alias("score"))
        if threshold is None:
            mean = imp.agg(F.avg("score")).first()[0]
            return _pick(imp, None, mean, n)
        return _pick(imp, None, threshold, n)
    if method == "lasso":
        return _pick(lasso_scores(df, feats, target, task), None,
                     threshold if threshold is not None else 1e-12, n)
    if method == "rfe":
        return rfe(df, feats, target, n_features or max(1, n // 2), task, seed, n_trees)
    if method == "rfecv":
        return rfecv(df, feats, target, task, cv, seed, n_trees)
    raise OperatorError(f"unknown selection method {method!r}")


def lasso_scores(df: DataFrame, features, target: str, task: str | None = None, alpha: float = 0.01,
                 C: float = 1.0) -> DataFrame:
    """FSL-2: |coefficient| of an L1 model (Lasso α / L1 logistic C)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    feats = list(features)
    task = _task(df, target, task)
    n = df.count()
    stages = [VectorAssembler(inputCols=feats, outputCol="_raw", handleInvalid="skip"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]
    if task == "regression":
        stages.append(LinearRegression(labelCol=target, regParam=alpha, elasticNetParam=1.0))
    else:
        stages.insert(0, StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"))
        stages.append(LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=1.0, maxIter=1000))
    m = Pipeline(stages=stages).fit(df).stages[-1]
    coef = np.abs(m.coefficients.toArray()) if task == "regression" else \
        np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    return df.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(feats, coef)], "feature string, score double")


def _forest_rounds(train: DataFrame, features, target: str, task: str, seed: int, n_trees: int, test: DataFrame | None = None):
    """left -> (importances, score on ``test``): a forest of ``train`` on the features left.
    Large tables are binned, drawn and summed by cell once for all rounds."""
    from tabloom.operators.tuning import score_of
    mt = "random_forest_regressor" if task == "regression" else "random_forest_classifier"
    metric, params, n = "r2" if task == "regression" else "accuracy", {"n_estimators": n_trees}, train.count()
    if task == "regression" and cells.suits(mt, params, n, len(features)):
        shared = cells.SharedForests(make_estimator(mt, params, seed, n, "features", target), train, features, n,
                                     test, test.count() if test is not None else 0)
        if shared.usable:
            def on_cells(left):
                model = shared.fit(left)
                return model.featureImportances.toArray(), shared.score(model, left, metric) if test is not None else None
            return on_cells

    def on_rows(left):
        model = build_pipeline(mt, left, target, task, params, seed, n).fit(train)
        return model.stages[-1].featureImportances.toArray(), \
            score_of(model.transform(test), task, target, metric) if test is not None else None
    return on_rows


def rfe(df: DataFrame, features, target: str, n_features: int, task: str | None = None,
        seed: int = 42, n_trees: int = 100) -> DataFrame:
    """FSL-3: drop the least important feature per round (forest importances)."""
    remaining = list(features)
    task = _task(df, target, task)
    ranking = {}
    rank = len(remaining)
    fitted = _forest_rounds(df, remaining, target, task, seed, n_trees) if rank > n_features else None
    while len(remaining) > n_features:
        worst = min(zip(fitted(remaining)[0], remaining))[1]
        ranking[worst] = rank
        rank -= 1
        remaining.remove(worst)
    for f in remaining:
        ranking[f] = 1
    rows = [(f, float(-ranking[f]), int(ranking[f]), ranking[f] == 1) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, score double, rank int, selected boolean")


def elimination_path(train: DataFrame, test: DataFrame, features, target: str, task: str, seed: int, n_trees: int) -> list[tuple]:
    """(features left, score on ``test``, feature dropped next) of every round of an
    elimination that sees ``train`` only; one fit per round gives both."""
    left, out = list(features), []
    fitted = _forest_rounds(train, left, target, task, seed, n_trees, test)
    while left:
        importances, score = fitted(left)
        worst = min(zip(importances, left))[1]
        out.append((list(left), score, worst))
        left.remove(worst)
    return out


def fold_paths(data: DataFrame, features, target: str, task: str, cv: int, seed: int, n_trees: int) -> list[list[tuple]]:
    """The elimination of every fold (``__tb_fold``), ranked without the fold's own rows; folds run together."""
    from concurrent.futures import ThreadPoolExecutor

    def one(fold):
        return elimination_path(data.filter(F.col("__tb_fold") != fold), data.filter(F.col("__tb_fold") == fold), features, target,
                                task, seed, n_trees)
    with ThreadPoolExecutor(max_workers=min(cv, 8)) as pool:
        return list(pool.map(one, range(cv)))


def rfecv(df: DataFrame, features, target: str, task: str | None = None, cv: int = 5, seed: int = 42,
          n_trees: int = 100) -> DataFrame:
    """FSL-4: elimination nested in cross-validation. Every fold ranks the features
    on its own training rows and scores each feature count on its test rows; the
    count with the best mean score (the smallest of equals) is kept, of the order
    that an elimination on all rows gives."""
    task = _task(df, target, task)
    feats = list(features)
    by_count: dict[int, list] = {}
    # folds hash the whole row; the rounds read features and target only
    data = kfold(df, cv, seed, None, "__tb_fold").select(*[qcol(c) for c in dict.fromkeys([*feats, target])], "__tb_fold").cache()
    try:
        for path in fold_paths(data, feats, target, task, cv, seed, n_trees):
            for left, score, _ in path:
                by_count.setdefault(len(left), []).append(score)
        order = rfe(data, feats, target, 1, task, seed, n_trees).orderBy("rank").collect()
    finally:
        data.unpersist()
    scores = [float(np.mean(by_count[m + 1])) for m in range(len(feats))]
    best = int(np.argmax(scores)) + 1
    rows = [(r["feature"], scores[i], i + 1, i < best) for i, r in enumerate(order)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, score double, rank int, selected boolean")
