"""Model quality floors, persistence, registry, catalog, files and workflow."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tabloom.operators import ensemble, ml, tuning
from tabloom.plans import fixtures as fx
from tabloom.plans import workflow
from tabloom.plans.queries_ml import LIN_FEATS, linear_data
from tabloom.sources import catalog, files, jdbc


@pytest.fixture(scope="module")
def data(spark):
    return linear_data(spark, SF_TINY).cache()


def test_linear_regression_floor(data):
    fm = ml.fit_model(data, LIN_FEATS, "y", "linear_regression")
    assert ml.evaluate(fm).first()["r2"] > 0.99


def test_ensemble_of_identical_models_is_the_model(data):
    fm = ml.fit_model(data, LIN_FEATS, "y", "linear_regression")
    v = ensemble.voting([fm, fm], [1.0, 3.0])
    a = fm.model.transform(fm.test).select("prediction").collect()
    b = v.transform(fm.test).select("prediction").collect()
    assert all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(sorted(a), sorted(b)))


def test_classifier_and_decode(data):
    fm = ml.fit_model(data, LIN_FEATS, "l_returnflag", "decision_tree_classifier", {"max_depth": 3.0})
    assert fm.labels == sorted(fm.labels)
    pred = ml.predict(fm, data.drop("l_returnflag"), keep=["l_orderkey"])
    assert set(r[0] for r in pred.select("predictions_decoded").distinct().collect()) <= set(fm.labels)
    m = ml.evaluate(fm).first()
    assert 0 <= m["accuracy"] <= 1


def test_bad_param_warns_and_keeps_default():
    with pytest.warns(UserWarning):
        est = ml.make_estimator("random_forest_regressor", {"no_such_param": 3})
    assert est.getNumTrees() == 100


def test_save_load_registry_compat(spark, data):
    fm = ml.fit_model(data, LIN_FEATS, "y", "linear_regression")
    path = tempfile.mkdtemp(prefix="tabloom-model-")
    ml.save_model(fm, path + "/m1")
    back = ml.load_model(path + "/m1")
    assert back.features == LIN_FEATS and back.feature_types
    reg = ml.ModelRegistry(spark, path + "/registry")
    reg.register("m1", "lin", fm, path + "/m1", {"r2": 1.0})
    reg.register("m2", "lin2", fm, path + "/m1", {"r2": 0.5})
    assert reg.count() == 2
    reg.delete("m1")
    assert [r["model_id"] for r in reg.list().collect()] == ["m2"]
    bad = data.drop("l_tax").withColumn("l_discount", F.col("l_discount").cast("string"))
    issues = {r["feature"]: r["issue"] for r in ml.check_compat(bad, back).collect()}
    assert issues == {"l_tax": "missing", "l_discount": "type_mismatch"}


def test_param_importance_and_random_candidates(spark):
    c = tuning.random_candidates({"a": [1, 5], "b": [0.1, 0.5], "c": ["x", "y"]}, 5, seed=1)
    assert all(1 <= x["a"] <= 5 and 0.1 <= x["b"] <= 0.5 and x["c"] in "xy" for x in c)
    res = spark.createDataFrame([(0, json.dumps({"a": 1}), 0, 0.5, None), (1, json.dumps({"a": 2}), 0, 0.7, None)],
                                "candidate long, params string, fold long, test_score double, train_score double")
    row = tuning.param_importance(res).first()
    assert row["param"] == "a" and abs(row["spread"] - 0.2) < 1e-12 and row["importance"] == 1.0


def test_csv_roundtrip_and_catalog(spark):
    o = fx.load(spark, SF_TINY, "orders").select("o_orderkey", "o_totalprice")
    path = tempfile.mkdtemp(prefix="tabloom-csv-") + "/orders"
    files.write_csv(o, path)
    back = files.read_csv(spark, path)
    assert back.count() == o.count() and back.columns == o.columns
    cat = catalog.Catalog(spark, seed=7)
    a = cat.create(back, description="orders csv")
    assert cat.exists(a) and catalog.shape(cat.read(a)) == (o.count(), 2)
    cat.set_labels(a, {"o_totalprice": "Total price"})
    schema, prev = catalog.overview(cat.read(a), 3, order_by="o_orderkey")
    assert "Total price" in prev.columns
    cat.rename(a, "orders")
    assert cat.sql(f"SELECT count(*) FROM {cat.view_name('orders')}").first()[0] == o.count()


def test_jdbc_urls():
    c = jdbc.Connection("POSTGRES", "db.example", 5432, "sales")
    assert c.url() == "jdbc:postgresql://db.example:5432/sales"
    assert jdbc.Connection("MSSQL", "h", 1433, "d", instance="i").url().endswith("instanceName=i")
    with pytest.raises(ValueError):
        jdbc.Connection("NOPE").url()


def test_workflow_reports_failures(spark):
    cat = catalog.Catalog(spark)
    cat.create(fx.load(spark, SF_TINY, "orders"), "o")
    res = workflow.run_step({"id": "x", "op": "no_such_op", "inputs": {"df": "o"}}, cat)
    assert not res.ok and "unknown operator" in res.error
    res = workflow.run_step({"id": "y", "op": "query", "inputs": {"df": "o"},
                             "args": {"predicate": "o_totalprice > 1", "bogus": 1}, "output": "q"}, cat)
    assert res.ok and cat.exists("q")
    with pytest.raises(ValueError):
        workflow.replay(workflow.record([], "empty", datasets=["need"]), {}, cat)
