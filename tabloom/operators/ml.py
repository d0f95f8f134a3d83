"""Model fitting, evaluation, prediction, persistence and registry (ML-1..14).

Models are ``pyspark.ml`` pipelines (label indexer + vector assembler +
estimator); training is distributed by Spark. Metrics are SQL aggregates over
the prediction table, so evaluating never pulls predictions to the driver.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, is_numeric, qcol, require_columns
from tabloom.operators import cells
from tabloom.operators.sampling import train_test_split

# The model types and their task (classification / regression).
MODEL_TASKS = {
    "linear_regression": "regression",
    "decision_tree_regressor": "regression",
    "random_forest_regressor": "regression",
    "gradient_boosting_regressor": "regression",
    "xgboost_regressor": "regression",
    "decision_tree_classifier": "classification",
    "random_forest_classifier": "classification",
    "gradient_boosting_classifier": "classification",
    "xgboost_classifier": "classification",
    "logistic_regression": "classification",
    "svm": "classification",
    "svr": "regression",
    "ridge": "regression",
    "lasso": "regression",
}

# Reference hyper-parameter names -> Spark parameter names.
PARAM_NAMES = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "learning_rate": "stepSize",
    "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy",
    "subsample": "subsamplingRate", "max_iter": "maxIter", "random_state": "seed",
    "max_bins": "maxBins", "fit_intercept": "fitIntercept", "min_info_gain": "minInfoGain",
    "min_child_weight": "minChildWeight", "colsample_bytree": "colsampleByTree", "reg_lambda": "regLambda",
    "reg_alpha": "regAlpha", "l1_ratio": "elasticNetParam",
}


def _n_rows_for_reg(n: int) -> int:
    return max(int(n), 1)


def make_estimator(model_type: str, params: dict | None = None, seed: int = 42, n_rows: int | None = None,
                   features_col: str = "features", label_col: str = "label"):
    """ML-7: estimator with reference defaults + mapped hyper-parameters.

    Unknown or invalid parameters warn and keep defaults; integral floats
    become ints; a JSON string is accepted for ``params``.
    """
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    if isinstance(params, str):
        params = json.loads(params) if params.strip() else {}
    params = dict(params or {})
    if model_type not in MODEL_TASKS:
        raise OperatorError(f"unknown model type {model_type!r}; use one of {sorted(MODEL_TASKS)}")
    n = _n_rows_for_reg(n_rows or 1)
    common = {"featuresCol": features_col, "labelCol": label_col}
    if model_type == "linear_regression":
        est = R.LinearRegression(solver="normal", **common)
    elif model_type == "ridge":
        est = R.LinearRegression(solver="normal", regParam=float(params.pop("alpha", 1.0)) / n,
                                 elasticNetParam=0.0, **common)
    elif model_type == "lasso":
        est = R.LinearRegression(regParam=float(params.pop("alpha", 1.0)), elasticNetParam=1.0, **common)
    elif model_type == "decision_tree_regressor":
        est = R.DecisionTreeRegressor(maxDepth=10, seed=seed, **common)
    elif model_type == "decision_tree_classifier":
        est = C.DecisionTreeClassifier(maxDepth=10, seed=seed, **common)
    elif model_type == "random_forest_regressor":
        est = R.RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed, **common)
    elif model_type == "random_forest_classifier":
        est = C.RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common)
    elif model_type == "gradient_boosting_regressor":
        est = R.GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed, **common)
    elif model_type == "gradient_boosting_classifier":
        est = C.GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed, **common)
    elif model_type in ("xgboost_regressor", "xgboost_classifier"):
        from tabloom.operators.boosting import SecondOrderBoosting
        est = SecondOrderBoosting(objective="squared" if model_type == "xgboost_regressor" else "softmax", seed=seed, **common)
    elif model_type == "logistic_regression":
        cval, penalty = float(params.pop("C", 1.0)), params.pop("penalty", "l2")
        mix = {"l1": 1.0, "l2": 0.0, "elasticnet": float(params.pop("l1_ratio", 0.5)), None: 0.0, "none": 0.0}
        if penalty not in mix:
            raise OperatorError(f"unknown penalty {penalty!r}")
        est = C.LogisticRegression(maxIter=1000, regParam=0.0 if penalty in (None, "none") else 1.0 / (cval * n),
                                   elasticNetParam=mix[penalty], standardization=False, **common)
    elif model_type == "svr":
        from tabloom.operators.kernels import EpsilonRegression
        est = EpsilonRegression(**common)
    else:  # svm: on kernel features, see build_pipeline
        cval = float(params.pop("C", 1.0))
        est = C.LinearSVC(regParam=1.0 / (cval * n), maxIter=1000, **common)
    if model_type in ("gradient_boosting_regressor", "gradient_boosting_classifier",
                      "xgboost_regressor", "xgboost_classifier") and "n_estimators" in params:
        params["maxIter"] = params.pop("n_estimators")
    for k, v in params.items():
        name = PARAM_NAMES.get(k, k)
        if isinstance(v, float) and v.is_integer() and name not in ("stepSize", "subsamplingRate", "regParam", "elasticNetParam", "C"):
            v = int(v)
        if name == "maxDepth" and isinstance(v, int) and v > 30:
            raise OperatorError("max_depth is limited to 30 by Spark's trees")
        if not est.hasParam(name):
            warnings.warn(f"parameter {k!r} not supported by {model_type}; ignored")
            continue
        try:
            est.set(est.getParam(name), v)
        except (TypeError, ValueError) as e:
            warnings.warn(f"bad value for {k!r}: {e}; default kept")
    return est


@dataclass
class FittedModel:
    model: object                   # PipelineModel
    model_type: str
    task: str
    features: list
    target: str
    labels: list | None = None      # class labels (alphabetical) for classification
    params: dict = field(default_factory=dict)
    feature_types: dict = field(default_factory=dict)
    test: DataFrame | None = None

    def metadata(self) -> dict:
        return {"model_type": self.model_type, "task": self.task, "features": self.features,
                "target": self.target, "labels": self.labels, "params": self.params,
                "feature_types": self.feature_types}


def task_of(model_type: str) -> str:
    return MODEL_TASKS[model_type]


BINARY_ONLY = ("gradient_boosting_classifier", "svm")


def build_pipeline(model_type, features, target, task, params=None, seed=42, n_rows=None,
                   n_classes: int | None = None):
    """Label indexer (classification) + assembler + estimator. Binary-only
    estimators (GBT, linear SVC) are wrapped in ``OneVsRest`` for > 2 classes.
    Support vector models with a ``kernel`` other than linear get a Nyström map
    before them (``gamma``, ``degree``, ``coef0``, ``n_components``). With many rows
    (``n_rows``) trees are fitted on cells of equal bins, see ``cells.py``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import OneVsRest
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    stages = []
    if task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc",
                                    handleInvalid="skip"))
    inputs, on_cells = list(features), cells.suits(model_type, params, n_rows, len(features))
    if on_cells:
        stages.append(cells.Bins(inputs))
        inputs = cells.bin_columns(len(inputs))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"))
    features_col = "features"
    if model_type in ("svm", "svr"):
        params = json.loads(params) if isinstance(params, str) and params.strip() else dict(params or {})
        options = {k: params.pop(k) for k in ("kernel", "gamma", "degree", "coef0", "n_components") if k in params}
        if options.get("kernel", "linear") != "linear":
            from tabloom.operators.kernels import KernelMap
            features_col = "kernel_features"
            options["nComponents"] = options.pop("n_components", 256)
            kernel_map = KernelMap(inputCol="features", outputCol=features_col, seed=seed, **options)
            if model_type == "svr" or (n_rows or 0) < cells.CELL_ROWS:
                stages.append(kernel_map)
    est = make_estimator(model_type, params, seed, n_rows, features_col,
                         label_col="label" if task == "classification" else target)
    if features_col != "features" and model_type == "svm":
        est.setStandardization(False)  # the map's scale is the kernel
    if model_type in BINARY_ONLY and (n_classes or 2) > 2:
        est = OneVsRest(classifier=est, featuresCol=features_col, labelCol="label", parallelism=4)
    if features_col != "features" and model_type == "svm" and (n_rows or 0) >= cells.CELL_ROWS:
        from tabloom.operators.kernels import WeightedMachine
        est = WeightedMachine(kernel_map, est)
    if on_cells:
        est = (cells.CellForest if model_type.startswith("random_forest") else cells.OnCells)(est, inputs, task)
    stages.append(est)
    return Pipeline(stages=stages)


def fit_model(df: DataFrame, features, target: str, model_type: str, params: dict | None = None,
              test_size: float = 0.2, seed: int = 42, key=None) -> FittedModel:
    """ML-8: checks, target encoding, exact hashed split, distributed fit."""
    feats = list(features)
    require_columns(df, feats + [target])
    bad = [f for f in feats if not is_numeric(df, f)]
    if bad:
        raise OperatorError(f"non-numeric features: {bad}")
    task = task_of(model_type)
    if task == "regression" and not is_numeric(df, target):
        raise OperatorError("regression target must be numeric")
    # split the whole rows, before columns go: rows that differ elsewhere stay apart
    split = train_test_split(df, test_size, seed, key=key, flag="__tb_test")
    data = split.select(*[qcol(c) for c in feats], qcol(target).cast("string").alias(target)
                        if task == "classification" else qcol(target).cast("double").alias(target),
                        *([qcol(key)] if key and key not in feats and key != target else []), "__tb_test")
    train, test = data.filter("NOT __tb_test").drop("__tb_test"), data.filter("__tb_test").drop("__tb_test")
    n_classes = None
    if task == "classification":
        per = data.filter(qcol(target).isNotNull()).groupBy(qcol(target).alias("c")).agg(
            F.count_if(~F.col("__tb_test")).alias("n"))
        row = per.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 0)).first()
        n_train, n_classes = row[0] or 0, row[1]
        if row[2]:
            raise OperatorError(f"{row[2]} of {n_classes} classes have no training row; use more data or a smaller test_size")
    else:
        n_train = train.count()
    pipe = build_pipeline(model_type, feats, target, task, params, seed, n_train, n_classes)
    model = pipe.fit(train)
    labels = list(model.stages[0].labels) if task == "classification" else None
    types = {f: dict(df.dtypes)[f] for f in feats}
    return FittedModel(model, model_type, task, feats, target, labels, dict(params or {}), types, test)


# --------------------------------------------------------------------------
# ML-9 / ML-10 metrics as SQL aggregates
# --------------------------------------------------------------------------


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """ML-9: MSE, RMSE, MAE, R² (0 when the label is constant), n."""
    a, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    e = p - a
    ss_tot = F.var_pop(a) * F.count(a)
    return pred.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
                    F.avg(F.abs(e)).alias("mae"),
                    F.when(ss_tot == 0, F.lit(0.0)).otherwise(1 - F.sum(e * e) / ss_tot).alias("r2"),
                    F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    n = F.sum(qcol(weight)).cast("long") if weight else F.count(F.lit(1))
    return pred.groupBy(qcol(label).alias("actual"), qcol(prediction).alias("predicted")).agg(n.alias("count"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           weight: str | None = None) -> DataFrame:
    """ML-10: accuracy and support-weighted precision / recall / F1 (0 when
    undefined), from the confusion counts (one small groupBy)."""
    cm = confusion(pred, label, prediction, weight)
    n, none = F.col("count"), F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(none)
    sides = F.array(F.struct(F.col("actual").alias("cls"), n.alias("support"), none.alias("pred_n"), hit.alias("tp")),
                    F.struct(F.col("predicted").alias("cls"), none.alias("support"), n.alias("pred_n"), none.alias("tp")))
    per = cm.select(F.explode(sides).alias("s")).groupBy("s.cls") \
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "pred_n", "tp")])  # predictions are computed once
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.select("cls", "support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f1"))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                   (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
                   (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                   F.sum("support").alias("n"))


def evaluate(fm: FittedModel, df: DataFrame | None = None) -> DataFrame:
    """Metrics on the held-out part (or on an explicit evaluation table)."""
    data = df if df is not None else fm.test
    pred = fm.model.transform(data)
    if fm.task == "regression":
        return regression_metrics(pred, fm.target, "prediction")
    return classification_metrics(pred, "label", "prediction")


def with_target(df: DataFrame, target: str, labels) -> DataFrame:
    """Classification pipelines index the target; unlabelled inference rows get
    a placeholder label so the indexer stage can run."""
    if labels and target not in df.columns:
        return df.withColumn(target, F.lit(labels[0]))
    return df


def predict(fm: FittedModel, df: DataFrame, keep=None) -> DataFrame:
    """ML-11: predictions (+ decoded class label) next to the kept columns."""
    out = fm.model.transform(with_target(df, fm.target, fm.labels))
    cols = [qcol(c) for c in (keep or [])] + [F.col("prediction").alias("predictions")]
    if fm.task == "classification" and fm.labels:
        lab = F.array(*[F.lit(x) for x in fm.labels])
        cols.append(F.element_at(lab, F.col("prediction").cast("int") + 1).alias("predictions_decoded"))
    return out.select(*cols)


def prediction_summary(pred: DataFrame, column: str = "predictions") -> DataFrame:
    from tabloom.operators.profile import describe
    return describe(pred, [column])


# --------------------------------------------------------------------------
# ML-12 .. ML-14
# --------------------------------------------------------------------------


def save_model(fm: FittedModel, path: str) -> str:
    """ML-12: pipeline + metadata JSON, both written through Spark (so the path
    may be any shared file system the cluster uses)."""
    fm.model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(fm.metadata()),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_model(path: str) -> FittedModel:
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    model = PipelineModel.load(f"{path}/pipeline")
    return FittedModel(model, meta["model_type"], meta["task"], meta["features"], meta["target"],
                       meta.get("labels"), meta.get("params", {}), meta.get("feature_types", {}))


class ModelRegistry:
    """ML-13: append-only Parquet table of registrations and tombstones."""

    SCHEMA = ("model_id string, name string, model_type string, task string, path string, "
              "metrics string, created_at timestamp, deleted boolean")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)  # nothing registered yet

    def register(self, model_id: str, name: str, fm: FittedModel, path: str, metrics: dict) -> None:
        row = [(model_id, name, fm.model_type, fm.task, path, json.dumps(metrics), None, False)]
        self.spark.createDataFrame(row, self.SCHEMA).withColumn("created_at", F.current_timestamp()) \
            .write.mode("append").parquet(self.path)

    def delete(self, model_id: str) -> None:
        row = [(model_id, None, None, None, None, None, None, True)]
        self.spark.createDataFrame(row, self.SCHEMA).withColumn("created_at", F.current_timestamp()) \
            .write.mode("append").parquet(self.path)

    def list(self, model_type: str | None = None, task: str | None = None) -> DataFrame:
        log = self._log()
        dead = log.filter("deleted").select("model_id")
        live = log.filter("NOT deleted").join(dead, "model_id", "left_anti")
        if model_type:
            live = live.filter(F.col("model_type") == model_type)
        if task:
            live = live.filter(F.col("task") == task)
        return live.orderBy(F.col("created_at").desc(), "model_id")

    def count(self, **kw) -> int:
        return self.list(**kw).count()


def check_compat(df: DataFrame, fm: FittedModel) -> DataFrame:
    """ML-14: missing features and type mismatches with suggestions."""
    dtypes = dict(df.dtypes)
    rows = []
    for f in fm.features:
        if f not in dtypes:
            rows.append((f, "missing", fm.feature_types.get(f), None, "add or map this column"))
        elif fm.feature_types.get(f) and dtypes[f] != fm.feature_types[f]:
            numeric = dtypes[f] in ("int", "bigint", "double", "float", "smallint", "tinyint") or \
                dtypes[f].startswith("decimal")
            hint = "compatible numeric type" if numeric else "cast to numeric"
            rows.append((f, "type_mismatch", fm.feature_types[f], dtypes[f], hint))
    return df.sparkSession.createDataFrame(
        rows, "feature string, issue string, expected string, found string, suggestion string")
