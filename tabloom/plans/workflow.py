"""Recorded analysis replay (PIP-1..3).

A workflow is plain JSON: an ordered list of steps ``{id, op, args, inputs,
output}``. ``inputs`` name catalog datasets that are passed to the operator as
DataFrames; ``output`` names the dataset the step creates. Replaying over
other tables only rebinds the input names, so the whole workflow becomes one
lazy Spark plan per output.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from tabloom.functions.expressions import OperatorError
from tabloom.operators import (clean, ensemble, fault, features, importance, knn_information, ml, profile, quality, relational, sampling,
                               stats, tuning, windows)
from tabloom.operators.forecast import arima, intermittent, metrics, moving, network, regressors, smoothing
from tabloom.sources.catalog import Catalog



def _table(fn, pick: int = 0):
    """An operator that returns several results, as the step of one of them."""
    def step(df, **kw):
        return fn(df, **kw)[pick]
    return step


def _judged(model, data, target: str):
    """Metrics of a model's predictions."""
    out = model.transform(data)
    if model.task == "regression":
        return ml.regression_metrics(out, target, "prediction")
    return ml.classification_metrics(out)


def fit_predict(df, **kw):
    """Fit a model (``ml.fit_model``) and return the test rows with predictions."""
    fitted = ml.fit_model(df, **kw)
    return ml.predict(fitted, fitted.test, keep=[*fitted.features, fitted.target])


def fit_metrics(df, **kw):
    """Fit a model (``ml.fit_model``) and return its metrics on the test rows."""
    fitted = ml.fit_model(df, **kw)
    return _judged(fitted, fitted.test, kw["target"])


def voting_metrics(df, model_types, weights=None, voting: str = "hard", **kw):
    """Fit one model per type, vote, and return the metrics on the test rows."""
    fitted = [ml.fit_model(df, model_type=t, **kw) for t in model_types]
    vote = ensemble.voting(fitted, weights, voting)
    return _judged(vote, fitted[0].test, kw["target"])


def _composite(build):
    def step(df, **kw):
        return build(df, **kw).transform(df)
    return step


def fault_vs_normal(df, **kw):
    return fault.fault_vs_normal(df, **kw)[0]


# op name -> (callable, names of its DataFrame parameters)
OPERATORS = {
    "create_column": (relational.create_column, ["df"]),
    "join": (relational.join, ["left", "right"]),
    "join_report": (relational.join_report, ["left", "right", "result"]),
    "combine": (relational.combine, ["dfs"]),
    "combine_report": (relational.combine_report, ["dfs", "result"]),
    "fix_misaligned": (_table(clean.fix_misaligned), ["df"]),
    "infer_types": (_table(clean.infer_types), ["df"]),
    "cleaning_plan": (clean.cleaning_plan, ["issues"]),
    "apply_plan": (_table(clean.apply_plan), ["df", "plan"]),
    "quality_score": (quality.quality_score, ["issues"]),
    "summarize_issues": (quality.summarize_issues, ["issues"]),
    "missing_summary": (_table(profile.missing_summary), ["df"]),
    "label_encode": (_table(features.label_encode), ["df"]),
    "lag_analysis": (_table(stats.lag_analysis), ["df"]),
    "lag_outliers": (stats.lag_outliers, ["lagged"]),
    "boosted_importance": (importance.boosted_importance, ["df"]),
    "fit_predict": (fit_predict, ["df"]),
    "fit_metrics": (fit_metrics, ["df"]),
    "regression_metrics": (ml.regression_metrics, ["pred"]),
    "classification_metrics": (ml.classification_metrics, ["pred"]),
    "voting": (voting_metrics, ["df"]),
    "stacking": (_composite(ensemble.stacking), ["df"]),
    "blending": (_composite(ensemble.blending), ["df"]),
    "tune": (_table(tuning.tune, 1), ["df"]),
    "smoothing_forecasts": (smoothing.smoothing_forecasts, ["ses", "others"]),
    "best_smoothing": (smoothing.best_smoothing, ["ses", "others"]),
    "tree_forecast": (_table(regressors.tree_forecast, 1), ["df"]),
    "future_periods": (metrics.future_periods, ["last"]),
    "fault_vs_normal": (fault_vs_normal, ["df"]),
}

# operators with one table as ``df`` and one table as result, by module
OPERATORS.update({name: (getattr(module, name), ["df"]) for module, names in {
    relational: ("project", "query", "query_report", "apply_mapping", "standardize_columns", "head", "page", "top_abs",
                 "rank_desc", "last_per_group"),
    sampling: ("sample", "train_test_split", "time_split", "kfold"),
    profile: ("describe", "null_counts", "unique_counts", "inspect", "group_stats", "duplicate_count", "modes", "zero_share",
              "covariance_matrix"),
    quality: ("quality_issues", "quality_report", "missing_issue_table", "numeric_text_share", "pattern_profile",
              "field_profile"),
    clean: ("fill", "drop_duplicates", "clip", "cast_column"),
    windows: ("aggregated_feature", "sma", "wma", "lag_features"),
    features: ("interaction", "standardize", "minmax_scale", "time_features"),
    stats: ("outliers", "outlier_counts", "correlation", "correlation_matrix", "average_rank", "f_regression", "chi2_scores",
            "mutual_info", "detect_tasks"),
    knn_information: ("mutual_info_knn",),
    importance: ("rf_importance", "linear_importance", "permutation_importance", "feature_importance", "select_features",
                 "lasso_scores", "rfe", "rfecv"),
    tuning: ("cross_validate", "learning_curve"),
    fault: ("health_score", "fault_patterns"),
    moving: ("sma_forecast", "sma_metrics", "wma_search", "wma_forecast"),
    smoothing: ("ses_search", "smoothing_search"),
    intermittent: ("croston", "croston_search"),
    arima: ("arima",),
    network: ("lag_network",),
    metrics: ("forecast_metrics",),
}.items() for name in names})


def register_operator(name: str, fn, frame_params=("df",)) -> None:
    OPERATORS[name] = (fn, list(frame_params))


@dataclass
class StepResult:
    id: str
    op: str
    ok: bool
    output: str | None
    error: str | None = None


def run_step(step: dict, catalog: Catalog, mapping: dict | None = None) -> StepResult:
    """PIP-3: look up the operator, keep only known parameters, bind inputs."""
    import inspect
    op = step.get("op")
    if op not in OPERATORS:
        return StepResult(step.get("id", ""), op, False, None, f"unknown operator {op!r}")
    fn, frame_params = OPERATORS[op]
    mapping = mapping or {}
    try:
        kwargs = {}
        for p in frame_params:
            ref = step.get("inputs", {}).get(p)
            if ref is None:
                raise OperatorError(f"step {step.get('id')} misses input {p!r}")
            if isinstance(ref, list):
                kwargs[p] = [catalog.read(mapping.get(r, r)) for r in ref]
            else:
                kwargs[p] = catalog.read(mapping.get(ref, ref))
        args = dict(step.get("args", {}))
        try:
            sig = inspect.signature(fn)
            if not any(v.kind == v.VAR_KEYWORD for v in sig.parameters.values()):
                args = {k: v for k, v in args.items() if k in sig.parameters}
        except (TypeError, ValueError):
            pass
        out = fn(**kwargs, **args)
        name = step.get("output") or catalog.new_id()
        catalog.create(out, name, f"step {step.get('id')}: {op}")
        return StepResult(step.get("id", ""), op, True, name)
    except Exception as e:  # noqa: BLE001 - a failing step is reported, the run continues
        return StepResult(step.get("id", ""), op, False, None, f"{type(e).__name__}: {e}")


def record(steps, name: str, description: str = "", datasets=None, seed: int = 42) -> str:
    """PIP-1: keep successful, replayable steps; returns the JSON spec."""
    keep = [s for s in steps if s.get("ok", True) and s.get("op") in OPERATORS]
    spec = {"name": name, "description": description, "datasets": list(datasets or []), "seed": seed,
            "steps": [{k: s[k] for k in ("id", "op", "args", "inputs", "output") if k in s} for s in keep]}
    return json.dumps(spec, sort_keys=True)


def replay(spec: str | dict, mapping: dict, catalog: Catalog) -> dict:
    """PIP-2: run a recorded workflow over other datasets.

    ``mapping`` binds every recorded input dataset to a catalog id (missing
    binding -> error). Generated output ids come from the recorded seed, so a
    replay is reproducible; outputs are returned under their recorded names.
    """
    if isinstance(spec, str):
        spec = json.loads(spec)
    missing = [d for d in spec.get("datasets", []) if d not in mapping]
    if missing:
        raise OperatorError(f"no mapping for recorded datasets {missing}")
    import random
    rng = random.Random(spec.get("seed", 42))
    env = dict(mapping)
    results = {}
    for step in spec["steps"]:
        out_name = step.get("output") or str(uuid.UUID(int=rng.getrandbits(128), version=4))
        bound_out = f"replay_{out_name}"
        res = run_step({**step, "output": bound_out}, catalog, env)
        env[out_name] = bound_out
        results[out_name] = res
    return {name: (catalog.read(r.output) if r.ok else r) for name, r in results.items()}
