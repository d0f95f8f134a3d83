"""Kernel map against the exact kernel matrix; support vector models on a ring."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tabloom.operators import kernels as K
from tabloom.operators import ml


def ring(n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.uniform(-1, 1), r.uniform(-1, 1)
        rows.append((i, a, b, "in" if a * a + b * b < .45 else "out", a * a + b * b + r.gauss(0, .02)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ring(), "i long, a double, b double, side string, r double").cache()


@pytest.mark.parametrize("options", [dict(kernel="rbf", gamma=0.7), dict(kernel="rbf"), dict(kernel="poly", gamma="auto", coef0=1.0),
                                     dict(kernel="poly", degree=2), dict(kernel="linear")])
def test_map_equals_exact_kernel(table, options):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table.filter("i < 60"))
    model = K.KernelMap(nComponents=60, **options).fit(df)
    got = sorted((r.i, r.kernel_features.toArray()) for r in model.transform(df).collect())
    phi, x = np.stack([g[1] for g in got]), np.array([[r.a, r.b] for r in sorted(df.collect())])
    gamma = options.get("gamma", "scale")
    gamma = {"scale": 1 / (2 * x.var()), "auto": .5}.get(gamma, gamma)
    exact = K.kernel_matrix(x, x, options["kernel"], gamma, options.get("degree", 3), options.get("coef0", 0.0))
    assert np.allclose(phi @ phi.T, exact, atol=1e-5)


def test_few_landmarks_approximate(table):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)
    got = sorted((r.i, r.kernel_features.toArray()) for r in K.KernelMap(gamma=1.0, nComponents=40).fit(df).transform(df).collect())
    phi, x = np.stack([g[1] for g in got]), np.array([[r.a, r.b] for r in sorted(df.collect())])
    assert np.abs(phi @ phi.T - K.kernel_matrix(x, x, "rbf", 1.0, 3, 0.0)).max() < 0.02


def test_ring_needs_a_kernel(table):
    score = {k: ml.evaluate(ml.fit_model(table, ["a", "b"], "side", "svm", {"kernel": k, "C": 10.0, "max_iter": 60, "n_components": 60}, key="i")).first().accuracy for k in ("linear", "rbf")}
    assert score["rbf"] > .93 > .8 > score["linear"]
    fit = {k: ml.evaluate(ml.fit_model(table, ["a", "b"], "r", "svr", {"kernel": k, "C": 10.0, "epsilon": 0.02, "n_components": 40}, key="i")).first().r2
           for k in ("linear", "rbf")}
    assert fit["rbf"] > .95 and fit["linear"] < .3


def test_support_vector_regression_is_a_minimum(spark):
    r = random.Random(5)
    rows = [(1000.0 + 40 * r.gauss(0, 1), 3.0) for _ in range(300)]
    rows = [(x, f, 0.05 * x + 7 + r.gauss(0, .4) + (30 if k % 10 == 0 else 0)) for k, (x, f) in enumerate(rows)]
    df = VectorAssembler(inputCols=["x", "f"], outputCol="features").transform(spark.createDataFrame(rows, "x double, f double, label double"))
    for c, epsilon in ((1.0, 0.5), (0.0001, 0.1)):
        m = K.EpsilonRegression(C=c, epsilon=epsilon).fit(df)
        w, b = m.getOrDefault("weights"), m.getOrDefault("intercept")

        def cost(w0, b0):
            return w0 * w0 / 2 + c * sum(max(0.0, abs(y - w0 * x - b0) - epsilon) for x, _, y in rows)

        assert w[1] == 0
        mean = sum(x for x, _, _ in rows) / len(rows)
        best = min(cost(w[0] + dw, b - dw * mean + db) for dw in np.linspace(-.02, .02, 41) for db in np.linspace(-.4, .4, 41))
        assert cost(w[0], b) <= best * 1.01 + 1e-6
        got = {round(r.prediction, 6) for r in m.transform(df).collect()}
        assert got == {round(w[0] * x + b, 6) for x, _, _ in rows}


def test_models_are_kept(table, tmp_path):
    for model_type, target in (("svm", "side"), ("svr", "r")):
        fm = ml.fit_model(table, ["a", "b"], target, model_type, {"kernel": "rbf", "n_components": 20, "max_iter": 20}, key="i")
        again = ml.load_model(ml.save_model(fm, str(tmp_path / model_type)))
        a, b = (sorted(r.predictions for r in ml.predict(m, table).collect()) for m in (fm, again))
        assert a == b


def test_bad_values(table):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(table)
    for bad in (dict(kernel="x"), dict(gamma="x")):
        with pytest.raises(ValueError):
            K.KernelMap(**bad).fit(df)
    with pytest.raises(ValueError):
        K.KernelMap().fit(df.filter("i < 0"))
    assert math.isclose(K.insensitive_loss(np.array([0.3]), 0.1, 0.01)[0][0], 0.195)


def test_logistic_penalties(table):
    for penalty in ("l1", "l2", "elasticnet", None):
        fm = ml.fit_model(table, ["a", "b"], "side", "logistic_regression", {"penalty": penalty, "C": 0.01}, key="i")
        weights = fm.model.stages[-1].coefficients.toArray()
        if penalty != "elasticnet":  # between both
            assert (np.abs(weights) < 1e-12).all() == (penalty == "l1")
    with pytest.raises(ml.OperatorError):
        ml.fit_model(table, ["a", "b"], "side", "logistic_regression", {"penalty": "l3"}, key="i")
