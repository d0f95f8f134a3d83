"""Trees on cells of equal bins against Spark's trees on all rows."""

import random

import numpy as np
import pytest

from tabloom.operators import cells, importance as imp, ml

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        a, b, c = r.randrange(12), r.randrange(6) / 10, r.choice([-1.5, 0.0, 2.0, None])
        rows.append((i, a, b, c, 2.0 * a - 7 * b + (c or 0) ** 2 + r.gauss(0, 1), "pqr"[(a + int(b * 10)) % 3 if r.random() < 0.8 else r.randrange(3)]))
    return spark.createDataFrame(rows, "id long, a int, b double, c double, y double, k string").repartition(3).cache()


def both(monkeypatch, table, model_type, target, task, params=None, n_classes=None):
    out = []
    for least in (1, 1 << 60):
        monkeypatch.setattr(cells, "CELL_ROWS", least)
        pipe = ml.build_pipeline(model_type, X, target, task, params, 42, 3000, n_classes)
        assert isinstance(pipe.getStages()[-1], (cells.OnCells, cells.CellForest)) == (least == 1)
        model = pipe.fit(table)
        pred = {r.id: r.prediction for r in model.transform(table).select("id", "prediction").collect()}
        out.append((model.stages[-1], pred))
    return out


@pytest.mark.parametrize("model_type,params", [("decision_tree_regressor", {"max_depth": 6}),
                                               ("decision_tree_regressor", {"max_depth": 30, "min_samples_leaf": 25}),
                                               ("gradient_boosting_regressor", {"n_estimators": 5})])
def test_same_regression_trees(monkeypatch, table, model_type, params):
    (m1, p1), (m2, p2) = both(monkeypatch, table, model_type, "y", "regression", params)
    assert p1.keys() == p2.keys() and 0 < len(p1) < 3000  # rows with a missing feature are skipped
    assert max(abs(p1[i] - p2[i]) for i in p1) < 1e-9
    assert np.allclose(m1.featureImportances.toArray(), m2.featureImportances.toArray())


def test_same_classes(monkeypatch, table):
    for model_type, params, n in (("decision_tree_classifier", {"min_samples_leaf": 3}, None), ("gradient_boosting_classifier", {"n_estimators": 4}, 3)):
        (_, p1), (_, p2) = both(monkeypatch, table, model_type, "k", "classification", params, n)
        assert p1 == p2


def test_grown_tree_is_sparks(monkeypatch, table):
    """One tree on all features without draws."""
    for target, task in (("y", "regression"), ("k", "classification")):
        kind = "regressor" if task == "regression" else "classifier"
        monkeypatch.setattr(cells, "CELL_ROWS", 1 << 60)
        plain = ml.build_pipeline(f"decision_tree_{kind}", X, target, task, {"max_depth": 7}, 42, 3000).fit(table).stages[-1]
        rows = table.na.drop(subset=X).toPandas()
        levels = [np.unique(rows[c]) for c in X]
        bins = np.stack([np.searchsorted(v, rows[c]) for c, v in zip(X, levels)], axis=1)
        stats = rows[["y"]].to_numpy() if task == "regression" else (rows["k"].to_numpy()[:, None] == np.array(list("pqr"))).astype(float)
        tree = cells.grow(bins, stats, np.ones(len(rows)), 7, 3, 1, 0.0, np.random.default_rng(1))
        assert sum(f >= 0 for f in tree["feature"]) == (plain.numNodes - 1) // 2
        assert np.allclose(cells.CellTree(tree, 3).featureImportances.toArray(), plain.featureImportances.toArray())


def test_forest_like_sparks(monkeypatch, table, tmp_path):
    (m1, p1), (m2, p2) = both(monkeypatch, table, "random_forest_regressor", "y", "regression", {"n_estimators": 60, "max_depth": 6})
    assert isinstance(m1, cells.CellForestModel) and len(m1.trees) == 60
    assert p1.keys() == p2.keys()
    a, b = np.array([p1[i] for i in sorted(p1)]), np.array([p2[i] for i in sorted(p2)])
    assert np.sqrt(((a - b) ** 2).mean()) < 0.1 * b.std()
    assert np.abs(m1.featureImportances.toArray() - m2.featureImportances.toArray()).max() < 0.1
    m1.write().overwrite().save(str(tmp_path / "m"))
    assert cells.CellForestModel.load(str(tmp_path / "m")).parts() == m1.parts()
    (m1, p1), (m2, p2) = both(monkeypatch, table, "random_forest_classifier", "k", "classification", {"n_estimators": 40})
    assert sum(p1[i] == p2[i] for i in p1) > 0.97 * len(p1)


def test_importance_and_missing_labels(spark, monkeypatch, table):
    monkeypatch.setattr(cells, "CELL_ROWS", 1)
    t = imp.rf_importance(table, X, "y", "regression", n_trees=20).collect()
    assert abs(sum(r.importance for r in t) - 1) < 1e-9 and all(r["std"] > 0 for r in t)
    holes = table.selectExpr("a", "b", "c", "if(id = 7 or a = 3, null, y) y")
    for mt in ("decision_tree_regressor", "random_forest_regressor"):
        with pytest.raises(Exception, match="NULL|null|NaN"):
            ml.build_pipeline(mt, X, "y", "regression", None, 42, 3000).fit(holes)


def test_cuts(spark):
    df = spark.range(4000).selectExpr("id * 1.0 v", "1.0 one", "id % 5 few", "cast(null as double) gone")
    many, one, few = cells.cut_points(df, ["v", "one", "few"])
    assert len(many) == 31 and few == [0.5, 1.5, 2.5, 3.5] and len(one) == 1
    assert all(abs(c - 125 * (i + 1)) <= 2 for i, c in enumerate(many))
