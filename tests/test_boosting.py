"""Second-order boosting against a plain version on the same bins."""

import math
import random

import numpy as np
import pytest

from tabloom.operators import boosting as B
from tabloom.operators import ml


def plain(bins, y, objective, trees, base, rounds, depth, step, lam, alpha, gamma, least, use):
    margin = np.full((len(y), trees), base)
    for turn in range(rounds):
        g, h = B.gradients(objective, y, margin)
        rows = np.flatnonzero(use(turn))
        add = np.zeros_like(margin)
        for k in range(trees):
            def value(a, b):
                a = math.copysign(max(abs(a) - alpha, 0), a)
                return a * a / (b + lam)

            def grow(fit, every, left):
                G, H = g[fit, k].sum(), h[fit, k].sum()
                best = None
                if left:
                    for f in range(bins.shape[1]):
                        for at in range(int(bins[:, f].max())):
                            side = bins[fit, f] <= at
                            gl, hl = g[fit[side], k].sum(), h[fit[side], k].sum()
                            if not side.any() or side.all() or hl < least or H - hl < least:
                                continue
                            gain = value(gl, hl) + value(G - gl, H - hl) - value(G, H)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, at)
                leaf = -step * math.copysign(max(abs(G) - alpha, 0), G) / (H + lam)
                if best is None:
                    return {"leaf": leaf, "rows": every}
                gain, f, at = best
                kids = [grow(fit[(bins[fit, f] <= at) == low], every[(bins[every, f] <= at) == low], left - 1) for low in (True, False)]
                if gain < gamma and all("leaf" in c for c in kids):
                    return {"leaf": leaf, "rows": every}
                return {"kids": kids}

            def put(node):
                if "leaf" in node:
                    add[node["rows"], k] = node["leaf"]
                else:
                    for c in node["kids"]:
                        put(c)

            put(grow(rows, np.arange(len(y)), depth))
        margin = margin + add
    return margin


def data(n=400, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), float(r.randint(0, 5)), r.random()
        rows.append((i, a, b, c, math.sin(2 * a) + b * c + r.gauss(0, .1), float(a + b / 4 > 0.6), float((b > 2) + (a > 0.5))))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame(data(), "i long, a double, b double, c double, y double, two double, three double").repartition(3, "i")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


@pytest.mark.parametrize("objective,label,options", [
    ("squared", "y", {}), ("squared", "y", dict(gamma=2.0, regAlpha=1.5, regLambda=3.0, minChildWeight=9.0)),
    ("logistic", "two", dict(minChildWeight=2.0)), ("softmax", "three", dict(maxDepth=3)), ("softmax", "two", {})])
@pytest.mark.parametrize("driver_bytes", [B.DRIVER_BYTES, 0])
def test_equals_plain_boosting(table, monkeypatch, objective, label, options, driver_bytes):
    monkeypatch.setattr(B, "DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    est = B.SecondOrderBoosting(labelCol=label, objective=objective, maxIter=3, maxDepth=4)
    est._set(maxBins=24, **options)
    model = est.fit(table)
    p = model.parts()
    rows = sorted(table.select("i", "a", "b", "c", label).collect())
    bins = np.stack([np.searchsorted(c, [r[j + 1] for r in rows], side="right") for j, c in enumerate(p["cuts"])], axis=1)
    y = np.array([r[4] for r in rows])
    v = lambda n: est.getOrDefault(n)
    want = plain(bins, y, p["objective"], p["trees"], p["base"], 3, v("maxDepth"), v("stepSize"), v("regLambda"), v("regAlpha"), v("gamma"),
                 v("minChildWeight"), lambda turn: np.ones(len(y), bool))
    raw = "prediction" if objective == "squared" else "rawPrediction"
    got = np.array([r[1] if raw == "rawPrediction" else [r[1]] for r in sorted(model.transform(table).select("i", raw).collect())])
    assert np.allclose(got, want, atol=1e-9)


def test_sampling_is_repeatable(table):
    fits = []
    for _ in range(2):
        est = B.SecondOrderBoosting(labelCol="y", maxIter=3)
        est._set(subsamplingRate=0.7, colsampleByTree=0.7)
        fits.append(est.fit(table).parts())
    assert fits[0] == fits[1]
    used = [{f for f in t["feature"] if f >= 0} for group in fits[0]["forest"] for t in group]
    assert all(len(u) <= 2 for u in used) and len(set(map(tuple, map(sorted, used)))) > 1


@pytest.mark.parametrize("model_type,target,floor", [("xgboost_regressor", "y", .9), ("xgboost_classifier", "three", .9)])
def test_fit_evaluate_save_load(spark, tmp_path, model_type, target, floor):
    df = spark.createDataFrame(data(1500), "i long, a double, b double, c double, y double, two double, three double")
    fm = ml.fit_model(df, ["a", "b", "c"], target, model_type, {"n_estimators": 15, "min_child_weight": 3, "gamma": 0.1, "subsample": 0.9}, key="i")
    row = ml.evaluate(fm).first()
    assert row["r2" if target == "y" else "accuracy"] > floor
    again = ml.load_model(ml.save_model(fm, str(tmp_path / "m")))
    a, b = (sorted(r.predictions for r in ml.predict(m, df).collect()) for m in (fm, again))
    assert a == b
    importance = fm.model.stages[-1].featureImportances.toArray()
    assert abs(importance.sum() - 1) < 1e-9 and importance.min() >= 0


def test_constant_and_empty(spark, table):
    from pyspark.ml.feature import VectorAssembler
    flat = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1.0, 3.0)] * 5, "a double, y double"))
    assert {r.prediction for r in B.SecondOrderBoosting(labelCol="y", maxIter=2).fit(flat).transform(flat).collect()} == {3.0}
    with pytest.raises(ValueError):
        B.SecondOrderBoosting(labelCol="y").fit(table.filter("i < 0"))
