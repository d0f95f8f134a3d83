import random

from tabloom.operators import importance
from tabloom.operators.sampling import kfold


def test_ranking_never_sees_the_fold_it_is_judged_on(spark):
    """A feature that equals the target in fold 0 only: useless to rank fold 0 with."""
    r = random.Random(1)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for i in range(240)]
    base = spark.createDataFrame(rows, "i long, a double, b double, noise double").selectExpr("*", "a + b as y")
    folds = {f.i: f["__tb_fold"] for f in kfold(base.selectExpr("*", "noise as leak"), 2, 42, "i", "__tb_fold").collect()}
    leaky = spark.createDataFrame([(i, a, b, (a + b) if folds[i] == 0 else n) for i, a, b, n in rows], "i long, a double, b double, leak double") \
        .selectExpr("*", "a + b as y")
    marked = leaky.join(spark.createDataFrame(list(folds.items()), "k long, fold long"), leaky.i == importance.F.col("k")).drop("k")
    parts = {f: marked.filter(f"fold = {f}") for f in (0, 1)}
    feats = ["a", "leak"]
    judged_on_0 = importance.elimination_path(parts[1], parts[0], feats, "y", "regression", 42, 10)
    judged_on_1 = importance.elimination_path(parts[0], parts[1], feats, "y", "regression", 42, 10)
    assert judged_on_0[0][2] == "leak"
    assert judged_on_1[-1][0] == ["leak"]
    assert judged_on_1[-1][1] < 0.3 < judged_on_0[-1][1]


def test_rfecv_keeps_what_helps(spark):
    r = random.Random(2)
    rows = [(r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, noise double").selectExpr("*", "2 * a + b as y")
    out = {x.feature: x for x in importance.rfecv(df, ["noise", "b", "a"], "y", "regression", cv=3, n_trees=8).collect()}
    assert [out[f]["rank"] for f in ("a", "b", "noise")] == [1, 2, 3]
    assert out["a"].selected and out["b"].selected
    assert out["b"].score > out["a"].score


def test_elimination_on_cells_bins_and_draws_once(spark, monkeypatch):
    """Large tables: one set of cuts and draws per training set, not per round, and the ranking of the rows."""
    from tabloom.operators import cells
    r = random.Random(3)
    rows = [(float(r.randint(0, 9)), float(r.randint(0, 40)), r.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, noise double").selectExpr("*", "a * 10 + b as y").cache()
    feats = ["noise", "b", "a"]
    plain = {x.feature: x for x in importance.rfecv(df, feats, "y", "regression", cv=2, n_trees=8).collect()}
    calls = []
    real = cells.cut_points
    monkeypatch.setattr(cells, "CELL_ROWS", 100)
    monkeypatch.setattr(cells, "cut_points", lambda *a, **k: calls.append(1) or real(*a, **k))
    out = {x.feature: x for x in importance.rfecv(df, feats, "y", "regression", cv=2, n_trees=8).collect()}
    assert len(calls) == 3  # two folds and the whole
    assert all(out[f]["rank"] == plain[f]["rank"] and abs(out[f].score - plain[f].score) < 0.05 for f in feats)
    shared = cells.SharedForests(importance.make_estimator("random_forest_regressor", {"n_estimators": 8}, 42, 3000, "features", "y"),
                                 df, feats, 3000, df, 3000)
    one = importance.rf_importance(df, feats, "y", "regression", n_trees=8).collect()
    model = shared.fit(feats)
    assert max(abs(model.featureImportances[feats.index(x.feature)] - x.importance) for x in one) < 0.02
    assert shared.score(model, feats, "r2") > 0.9
    gap = df.withColumn("a", importance.F.expr("IF(a = 3 AND b = 7, NULL, a)"))
    assert not cells.SharedForests(shared.est, gap, feats, 3000).usable
