"""Hyper-parameter search and curves (ML-18..23).

Folds are hash-assigned (SMP-7) so they are stable under retries. Each
(candidate, fold) fit is an ordinary distributed Spark fit; up to
``parallelism`` of them are submitted concurrently from driver threads, as
``CrossValidator(parallelism=...)`` does. Results are tables: one row per
candidate and fold, summarised with SQL aggregates.
"""

from __future__ import annotations

import itertools
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError
from tabloom.operators import cells, moments
from tabloom.operators.ml import build_pipeline, classification_metrics, make_estimator, regression_metrics, task_of
from tabloom.operators.sampling import hash_column, kfold
from tabloom.session import cut_lineage

# Search grids per model family, for the parameters that Spark's
# estimators have (unlimited depth is 30 here, the limit of Spark's trees).
GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [30, 10, 20], "min_samples_leaf": [1, 2, 4],
                      "max_features": ["sqrt", "log2", "all"]},
    "decision_tree": {"max_depth": [30, 5, 10, 15, 20], "min_samples_leaf": [1, 2, 4, 8]},
    "gradient_boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                          "max_depth": [3, 5, 7, 9], "min_samples_leaf": [1, 2, 4], "subsample": [0.8, 0.9, 1.0]},
    "xgboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 5, 7, 9],
                "min_child_weight": [1, 3, 5], "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0],
                "gamma": [0, 0.1, 0.2]},
    "svm": {"kernel": ["linear", "poly", "rbf"], "C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto", 0.1, 1.0]},
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "fit_intercept": [True, False]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2", "elasticnet", None],
                            "fit_intercept": [True, False]},
}

FAMILY_TYPES = {
    ("random_forest", "regression"): "random_forest_regressor",
    ("random_forest", "classification"): "random_forest_classifier",
    ("decision_tree", "regression"): "decision_tree_regressor",
    ("decision_tree", "classification"): "decision_tree_classifier",
    ("gradient_boosting", "regression"): "gradient_boosting_regressor",
    ("gradient_boosting", "classification"): "gradient_boosting_classifier",
    ("xgboost", "regression"): "xgboost_regressor",
    ("xgboost", "classification"): "xgboost_classifier",
    ("svm", "classification"): "svm",
    ("svm", "regression"): "svr",
    ("ridge", "regression"): "ridge",
    ("lasso", "regression"): "lasso",
    ("logistic_regression", "classification"): "logistic_regression",
}

REGRESSION_METRICS = ("r2", "rmse", "mse")
CLASSIFICATION_METRICS = ("accuracy", "f1", "precision", "recall")


def model_type_for(family: str, task: str) -> str:
    if (family, task) not in FAMILY_TYPES:
        raise OperatorError(f"no {task} model for family {family!r}")
    return FAMILY_TYPES[(family, task)]


def expand_grid(grid: dict) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, combo)) for combo in itertools.product(*[grid[k] for k in names])]


def random_candidates(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """ML-19: ints/floats uniform between the grid's min and max, else choice."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_iter):
        cand = {}
        for k, values in grid.items():
            vals = list(values)
            if all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
                cand[k] = rng.randint(min(vals), max(vals))
            elif all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals):
                cand[k] = rng.uniform(min(vals), max(vals))
            else:
                cand[k] = rng.choice(vals)
        out.append(cand)
    return out


def score_of(pred: DataFrame, task: str, target: str, metric: str) -> float:
    if task == "regression":
        row = regression_metrics(pred, target, "prediction").first()
        val = row[metric]
        return -val if metric in ("rmse", "mse") else val   # higher is better
    row = classification_metrics(pred, "label", "prediction").first()
    return row[metric]


def cross_validate(df: DataFrame, features, target: str, model_type: str, candidates, k: int = 5,
                   metric: str | None = None, seed: int = 42, key=None, parallelism: int = 4,
                   train_scores: bool = True) -> DataFrame:
    """Fit every candidate on k-1 folds and score the held-out fold (and the
    training folds). Returns (candidate, params, fold, test_score, train_score)."""
    task = task_of(model_type)
    metric = metric or ("r2" if task == "regression" else "accuracy")
    allowed = REGRESSION_METRICS if task == "regression" else CLASSIFICATION_METRICS
    if metric not in allowed:
        raise OperatorError(f"metric must be one of {allowed}")
    scored = _from_sums(df, list(features), target, model_type, candidates, k, metric, seed, key, parallelism, train_scores)
    if scored is not None:
        return df.sparkSession.createDataFrame(scored, CV_SCHEMA)
    # every (candidate, fold) fit re-reads the table: keep it cached for the
    # duration of the search (all jobs finish inside this function)
    data = kfold(df, k, seed, key, "_fold").cache()
    n = data.count()

    def run(job):
        ci, params, fold = job
        train, test = data.filter(F.col("_fold") != fold), data.filter(F.col("_fold") == fold)
        model = build_pipeline(model_type, features, target, task, params, seed, int(n * (k - 1) / k)).fit(train)
        te = score_of(model.transform(test), task, target, metric)
        tr = score_of(model.transform(train), task, target, metric) if train_scores else None
        return (ci, json.dumps(params, sort_keys=True), fold, float(te), None if tr is None else float(tr))

    jobs = [(ci, p, f) for ci, p in enumerate(candidates) for f in range(k)]
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = list(pool.map(run, jobs))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, CV_SCHEMA)


CV_SCHEMA = "candidate long, params string, fold long, test_score double, train_score double"
LINEAR = ("linear_regression", "ridge", "lasso")


def _from_sums(df, feats, target, model_type, candidates, k, metric, seed, key, parallelism, train_scores) -> list | None:
    """Fits and scores of a large table from sums that one pass leaves per fold: moments
    for linear models, cells of equal bins for decision trees; None for other models."""
    if model_type not in LINEAR and not model_type.startswith("decision_tree_"):
        return None
    n = df.count()
    task = task_of(model_type)
    if n < cells.CELL_ROWS or not (model_type in LINEAR or all(cells.suits(model_type, p, n, len(feats)) for p in candidates)):
        return None
    data = kfold(df, k, seed, key, "_fold")
    n_train = int(n * (k - 1) / k)
    if model_type in LINEAR:
        sums = moments.by_group(data, feats, target, ["_fold"])
        if sums is None:
            return None

        def run(job):
            ci, params, fold = job
            train, test = (moments.merge([m for (f,), m in sums.items() if (f == fold) == held]) for held in (False, True))
            model = moments.fit(df.sparkSession, build_pipeline(model_type, feats, target, task, params, seed, n_train), feats, target, train)
            return (ci, json.dumps(params, sort_keys=True), fold, moments.score(model, test, metric),
                    moments.score(model, train, metric) if train_scores else None)
    else:
        bins, cols = cells.Bins(feats).fit(data), cells.bin_columns(len(feats))
        rows = cut_lineage(cells.weighted(bins.transform(data), cols, target, task, ["_fold"]))
        rows = cells.assembled(cells.few_tasks(rows, rows.count()), cols, "features").cache()

        def run(job):
            from pyspark.ml.feature import StringIndexer
            ci, params, fold = job
            train, test = rows.filter(F.col("_fold") != fold), rows.filter(F.col("_fold") == fold)
            if task == "classification":
                index = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
                train, test = index.transform(train), index.transform(test)
            est = make_estimator(model_type, params, seed, n_train, label_col="label" if task == "classification" else target)
            model = cells.fit_weighted(est, train, train.agg(F.sum("__tb_w")).first()[0])
            return (ci, json.dumps(params, sort_keys=True), fold, float(cells.weighted_score(model.transform(test), task, target, metric)),
                    float(cells.weighted_score(model.transform(train), task, target, metric)) if train_scores else None)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(run, [(ci, p, f) for ci, p in enumerate(candidates) for f in range(k)]))


def tune(df: DataFrame, features, target: str, family: str, task: str | None = None, method: str = "grid",
         param_grid: dict | None = None, n_iter: int = 10, k: int = 5, metric: str | None = None,
         seed: int = 42, key=None, parallelism: int = 4):
    """ML-18/19/20: grid or random search; returns (cv_results, summary, best_params)."""
    if task is None:
        task = "classification" if family in ("svm", "logistic_regression") else "regression"
    model_type = model_type_for(family, task)
    grid = param_grid or GRIDS.get(family, {})
    cands = expand_grid(grid) if method == "grid" else random_candidates(grid, n_iter, seed)
    if not cands:
        cands = [{}]
    res = cross_validate(df, features, target, model_type, cands, k, metric, seed, key, parallelism)
    summary = cv_summary(res)
    best = summary.filter("rank = 1").first()
    return res, summary, json.loads(best["params"]) if best else {}


def cv_summary(results: DataFrame) -> DataFrame:
    """ML-22: mean/std (population) of test and train scores per candidate."""
    agg = results.groupBy("candidate", "params").agg(
        F.avg("test_score").alias("mean_test_score"), F.stddev_pop("test_score").alias("std_test_score"),
        F.avg("train_score").alias("mean_train_score"), F.stddev_pop("train_score").alias("std_train_score"),
        F.count(F.lit(1)).alias("folds"))
    w = Window.orderBy(F.col("mean_test_score").desc(), "candidate")  # one row per candidate
    return agg.withColumn("rank", F.row_number().over(w))


def param_importance(results: DataFrame, score: str = "test_score") -> DataFrame:
    """ML-21: per parameter, spread (max − min) of the mean score by value,
    normalised by the largest spread."""
    per_cand = results.groupBy("candidate", "params").agg(F.avg(score).alias("_s"))
    kv = per_cand.select("_s", F.explode(F.from_json("params", "map<string,string>")).alias("param", "value"))
    by_val = kv.groupBy("param", "value").agg(F.avg("_s").alias("_m"))
    spread = by_val.groupBy("param").agg((F.max("_m") - F.min("_m")).alias("spread"))
    w = Window.partitionBy()  # one row per parameter
    return spread.withColumn("importance", F.when(F.max("spread").over(w) > 0,
                                                  F.col("spread") / F.max("spread").over(w)).otherwise(0.0))


def learning_curve(df: DataFrame, features, target: str, model_type: str, sizes=(0.1, 0.3, 0.5, 0.7, 0.9),
                   k: int = 5, metric: str | None = None, seed: int = 42, key=None,
                   parallelism: int = 4) -> DataFrame:
    """ML-23: train/test score mean and std per training-set fraction."""
    task = task_of(model_type)
    metric = metric or ("r2" if task == "regression" else "accuracy")
    h, bits = hash_column(df, key, seed + 1)
    data = kfold(df, k, seed, key, "_fold").withColumn("_u", h / F.lit(float(1 << bits)))
    sums = None
    if model_type in LINEAR and df.count() >= cells.CELL_ROWS:
        steps = sorted(sizes)
        step = F.lit(len(steps))
        for i, s in reversed(list(enumerate(steps))):
            step = F.when(F.col("_u") < s, F.lit(i)).otherwise(step)
        sums = moments.by_group(data.withColumn("_step", step), list(features), target, ["_fold", "_step"])
    if sums is None:
        data = data.cache()

    def run(job):
        size, fold = job
        if sums is not None:
            train = moments.merge([m for (f, i), m in sums.items() if f != fold and i <= steps.index(size)])
            test = moments.merge([m for (f, _), m in sums.items() if f == fold])
            model = moments.fit(df.sparkSession, build_pipeline(model_type, features, target, task, None, seed), list(features), target, train)
            return float(size), fold, moments.score(model, train, metric), moments.score(model, test, metric)
        train = data.filter((F.col("_fold") != fold) & (F.col("_u") < size))
        test = data.filter(F.col("_fold") == fold)
        model = build_pipeline(model_type, features, target, task, None, seed).fit(train)
        return (float(size), fold, float(score_of(model.transform(train), task, target, metric)),
                float(score_of(model.transform(test), task, target, metric)))

    jobs = [(s, f) for s in sizes for f in range(k)]
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = list(pool.map(run, jobs))
    finally:
        data.unpersist()
    res = df.sparkSession.createDataFrame(rows, "train_size double, fold long, train_score double, test_score double")
    return res.groupBy("train_size").agg(F.avg("train_score").alias("train_mean"),
                                         F.stddev_pop("train_score").alias("train_std"),
                                         F.avg("test_score").alias("test_mean"),
                                         F.stddev_pop("test_score").alias("test_std"))
