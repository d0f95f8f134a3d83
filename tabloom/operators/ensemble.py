"""Model ensembles (ML-15..17): voting, stacking, blending.

Base models are applied one after another to the same DataFrame (each
prediction renamed to its own column), so an ensemble prediction is one
lineage with no joins; votes are array expressions evaluated per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, qcol, require_columns
from tabloom.operators.ml import FittedModel, build_pipeline, task_of, with_target
from tabloom.operators.sampling import kfold, train_test_split
from tabloom.session import cut_lineage

def apply_models(models, df: DataFrame, prefix: str = "_m") -> DataFrame:
    """Append ``{prefix}{i}`` (prediction) and ``{prefix}{i}_prob`` (class
    probabilities, classification) for every model."""
    out = df
    for i, m in enumerate(models):
        pm = m.model if isinstance(m, FittedModel) else m
        t = pm.transform(out)
        keep = [c for c in out.columns]
        extra = [F.col("prediction").alias(f"{prefix}{i}")]
        if "probability" in t.columns:
            extra.append(vector_to_array("probability").alias(f"{prefix}{i}_prob"))
        out = t.select(*[qcol(c) for c in keep], *extra)
    return out


def argmax(scores: Column) -> Column:
    """0-based index of the largest element (lowest index on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def hard_vote(pred_cols, weights, n_classes: int) -> Column:
    """Weighted majority class from prediction columns (class indices)."""
    scores = F.array(*[sum((F.when(F.col(p) == float(c), F.lit(float(w))).otherwise(F.lit(0.0))
                            for p, w in zip(pred_cols, weights)), F.lit(0.0)) for c in range(n_classes)])
    return argmax(scores)


def soft_vote(prob_cols, weights) -> Column:
    """Weighted mean class probability, rounded to 12 decimals so that equal
    classes tie (and the first one wins) whatever the order of summation."""
    total = float(sum(weights))
    def add(weight):
        return lambda a, b: a + b * F.lit(float(weight))

    acc = F.transform(F.col(prob_cols[0]), lambda x: x * F.lit(float(weights[0])))
    for p, w in zip(prob_cols[1:], weights[1:]):
        acc = F.zip_with(acc, F.col(p), add(w))
    return F.transform(acc, lambda x: F.round(x / F.lit(total), 12))


def weighted_mean(pred_cols, weights) -> Column:
    total = float(sum(weights))
    return sum((F.col(p) * F.lit(float(w)) for p, w in zip(pred_cols, weights)), F.lit(0.0)) / F.lit(total)


@dataclass
class VotingModel:
    models: list
    weights: list
    voting: str
    task: str
    labels: list | None

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(self.models)
        out = apply_models(self.models, with_target(df, self.models[0].target, self.labels))
        preds = [f"_m{i}" for i in range(n)]
        if self.task == "regression":
            res = out.withColumn("prediction", weighted_mean(preds, self.weights))
        elif self.voting == "soft":
            res = out.withColumn("probability", soft_vote([f"{p}_prob" for p in preds], self.weights)) \
                .withColumn("prediction", argmax(F.col("probability")))
        else:
            res = out.withColumn("prediction", hard_vote(preds, self.weights, len(self.labels)))
        if self.labels:
            lab = F.array(*[F.lit(x) for x in self.labels])
            res = res.withColumn("prediction_decoded", F.element_at(lab, F.col("prediction").cast("int") + 1))
            target = self.models[0].target
            res = res.withColumn("label", (F.array_position(lab, F.col(target).cast("string")) - 1).cast("double"))
        return res.drop(*preds, *[f"{p}_prob" for p in preds])


def voting(models, weights=None, voting: str = "hard") -> VotingModel:
    """ML-15: ≥ 2 fitted models with the same task, features and target."""
    models = list(models)
    if len(models) < 2:
        raise OperatorError("voting needs at least two models")
    first = models[0]
    for m in models[1:]:
        if (m.task, m.features, m.target) != (first.task, first.features, first.target):
            raise OperatorError("all models must share task, features and target")
    w = list(weights) if weights else [1.0] * len(models)
    if len(w) != len(models):
        raise OperatorError("weights length must equal the number of models")
    if voting not in ("hard", "soft"):
        raise OperatorError("voting must be 'hard' or 'soft'")
    return VotingModel(models, w, voting, first.task, first.labels)


def _meta_columns(n: int, task: str, n_classes: int | None):
    if task == "regression":
        return [f"_m{i}" for i in range(n)]
    return [f"_m{i}_p{c}" for i in range(n) for c in range(n_classes)]


def _expand_probs(df: DataFrame, n: int, n_classes: int) -> DataFrame:
    return df.select("*", *[F.col(f"_m{i}_prob")[c].alias(f"_m{i}_p{c}") for i in range(n) for c in range(n_classes)])


@dataclass
class StackedModel:
    bases: list
    meta: object
    task: str
    labels: list | None
    method: str
    target: str

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(self.bases)
        out = apply_models(self.bases, with_target(df, self.target, self.labels))
        if self.task == "classification":
            out = _expand_probs(out, n, len(self.labels))
        return self.meta.transform(out)


def _fit_bases(train: DataFrame, features, target, task, base_types, seed):
    n_train = train.count()
    return [build_pipeline(bt, features, target, task, None, seed, n_train).fit(train) for bt in base_types]


def _meta_pipeline(meta_type, meta_cols, target, task, seed, n):
    return build_pipeline(meta_type, meta_cols, target, task, None, seed, n)


def _chosen(df: DataFrame, features, use_features) -> list:
    """``features``, or the part of them that ``use_features`` names (in its order)."""
    feats = list(features)
    if use_features is None:
        return feats
    chosen = [use_features] if isinstance(use_features, str) else list(use_features)
    unknown = [c for c in chosen if c not in feats]
    if unknown or not chosen:
        raise OperatorError(f"use_features must name some of the features; unknown: {unknown}")
    require_columns(df, chosen)
    return chosen


def stacking(df: DataFrame, features, target: str, base_types, meta_type: str, cv: int = 5,
             seed: int = 42, key=None, use_features=None) -> StackedModel:
    """ML-16: out-of-fold base predictions (hash folds) train the meta model;
    base models are then refitted on all rows for inference. ``use_features``
    restricts the base models to a part of the features; the others need not be
    there when the model is applied."""
    features = _chosen(df, features, use_features)
    task = task_of(base_types[0])
    data = kfold(df, cv, seed, key, "_fold")
    parts = []
    labels = None
    for k in range(cv):
        train, hold = data.filter(F.col("_fold") != k), data.filter(F.col("_fold") == k)
        bases = _fit_bases(train, features, target, task, base_types, seed)
        if task == "classification":
            labels = list(bases[0].stages[0].labels)
        parts.append(apply_models(bases, hold))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    if task == "classification":
        oof = _expand_probs(oof, len(base_types), len(labels))
    oof = cut_lineage(oof)
    meta_cols = _meta_columns(len(base_types), task, len(labels) if labels else None)
    meta = _meta_pipeline(meta_type, meta_cols, target, task, seed, oof.count()).fit(oof)
    finals = _fit_bases(data, features, target, task, base_types, seed)
    return StackedModel(finals, meta, task, labels, "stacking", target)


def blending(df: DataFrame, features, target: str, base_types, meta_type: str, holdout: float = 0.2,
             seed: int = 42, key=None, use_features=None) -> StackedModel:
    """ML-17: bases on 80 %, meta model on their predictions for the other 20 %.
    ``use_features`` as for :func:`stacking`."""
    features = _chosen(df, features, use_features)
    task = task_of(base_types[0])
    split = train_test_split(df, holdout, seed, key, "_blend")
    train, hold = split.filter("NOT _blend"), split.filter("_blend")
    bases = _fit_bases(train, features, target, task, base_types, seed)
    labels = list(bases[0].stages[0].labels) if task == "classification" else None
    preds = apply_models(bases, hold)
    if task == "classification":
        preds = _expand_probs(preds, len(base_types), len(labels))
    meta_cols = _meta_columns(len(base_types), task, len(labels) if labels else None)
    meta = _meta_pipeline(meta_type, meta_cols, target, task, seed, preds.count()).fit(preds)
    return StackedModel(bases, meta, task, labels, "blending", target)
