"""Fits and searches from sums of a large table against the passes over all rows."""

import random

import numpy as np
import pytest

from tabloom.operators import boosting, cells, ml, tuning

X = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        a, b = r.randrange(15), r.choice([0.1, 0.4, 3.0, None])
        rows.append((i, a, b, 3.0 * a - (b or 0) + r.gauss(0, 1), "uvw"[(a // 5 + (r.random() < 0.2)) % 3]))
    return spark.createDataFrame(rows, "id long, a int, b double, y double, k string").repartition(3).cache()


def compared(monkeypatch, module, run):
    out = []
    for least in (1, 1 << 60):
        monkeypatch.setattr(module, "CELL_ROWS", least)
        out.append(run())
    return out


@pytest.mark.parametrize("model_type,target,params", [
    ("ridge", "y", [{"alpha": 5.0, "fit_intercept": True}, {"alpha": 100.0, "fit_intercept": False}]),
    ("lasso", "y", [{"alpha": 0.5}]),
    ("decision_tree_regressor", "y", [{"max_depth": 4, "min_samples_leaf": 30}, {"max_depth": 9}]),
    ("decision_tree_classifier", "k", [{"max_depth": 5, "min_samples_leaf": 4}])])
def test_search(monkeypatch, table, model_type, target, params):
    for metric in (["r2", "rmse"] if target == "y" else ["f1"]):
        new, old = compared(monkeypatch, cells, lambda: sorted(map(tuple, tuning.cross_validate(
            table, X, target, model_type, params, 3, metric).collect())))
        assert [r[:3] for r in new] == [r[:3] for r in old]
        assert np.allclose([r[3:] for r in new], [r[3:] for r in old], atol=1e-8)


def test_search_reads_the_table_once_for_all_candidates(monkeypatch, table):
    monkeypatch.setattr(cells, "CELL_ROWS", 1)
    seen = []
    real = tuning.moments.by_group
    monkeypatch.setattr(tuning.moments, "by_group", lambda *a: seen.append(1) or real(*a))
    tuning.cross_validate(table, X, "y", "ridge", tuning.expand_grid(tuning.GRIDS["ridge"]), 3)
    assert seen == [1]
    holes = table.selectExpr("id", "a", "b", "if(a = 3, null, y) y")
    assert real(holes, X, "y", []) is None


def test_learning_curve(monkeypatch, table):
    new, old = compared(monkeypatch, cells, lambda: sorted(map(tuple, tuning.learning_curve(
        table, X, "y", "linear_regression", (0.5, 0.2, 0.9), 3).collect())))
    assert np.allclose(new, old, atol=1e-8)


@pytest.mark.parametrize("model_type,target", [("xgboost_regressor", "y"), ("xgboost_classifier", "k")])
def test_second_order_trees(monkeypatch, table, model_type, target):
    read = []
    real = boosting._cut
    monkeypatch.setattr(boosting, "_cut", lambda cuts, margin0, of=None: read.append(of is not None) or real(cuts, margin0, of))

    def run():
        task = ml.task_of(model_type)
        m = ml.build_pipeline(model_type, X, target, task, {"n_estimators": 5, "max_depth": 3}, 42, 1500).fit(table)
        rows = m.transform(table).select("id", "prediction").collect()
        return {r.id: r.prediction for r in rows}, m.stages[-1].featureImportances.toArray()

    (p1, f1), (p2, f2) = compared(monkeypatch, boosting, run)
    assert read == [True, False] and p1.keys() == p2.keys()
    assert max(abs(p1[i] - p2[i]) for i in p1) < 1e-9 and np.allclose(f1, f2)


def test_kernel_machine(monkeypatch, table):
    def run():
        pipe = ml.build_pipeline("svm", X, "k", "classification", {"kernel": "rbf", "n_components": 20}, 42, 1500, 3)
        m = pipe.fit(table)
        rows = m.transform(table).select("id", "prediction", "label").collect()
        return len(m.stages), {r.id: r.prediction for r in rows}, sum(r.prediction == r.label for r in rows) / len(rows)

    (n1, p1, a1), (n2, p2, a2) = compared(monkeypatch, cells, run)
    assert n1 == n2 - 1 and p1.keys() == p2.keys()
    # the hinge has corners, so the solver's stops differ a little between equal losses
    assert sum(p1[i] == p2[i] for i in p1) >= 0.95 * len(p1) and abs(a1 - a2) < 0.03


def test_metrics_of_missing_labels(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (None, 1.0), (2.0, None), (2.0, 2.0)]
    r = ml.classification_metrics(spark.createDataFrame(rows, "label double, prediction double")).first()
    assert (r.n, r.accuracy) == (6, 0.5) and abs(r.precision - (2 * 1 + 1 / 3 + 2 * 1) / 6) < 1e-12
