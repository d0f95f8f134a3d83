"""Every registered query against its DuckDB oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import rows_of
from tabloom.plans.fixtures import TABLES

from conftest import SF_TINY

ORACLE = E.oracle_sql()
ROWS_ONLY = sorted(set(E.queries()) - set(ORACLE))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_TINY).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


#: Least values of result columns of the queries that have no oracle.
FLOORS = {
    "ml_fit_linear_regression": {"r2": 0.5}, "ml_fit_ridge": {"r2": 0.5}, "ml_fit_lasso": {"r2": 0.5},
    "ml_fit_random_forest_regressor": {"r2": 0.5}, "ml_fit_gradient_boosting_regressor": {"r2": 0.5},
    "ml_fit_decision_tree_regressor": {"r2": 0.5}, "ml_fit_xgboost_regressor": {"r2": 0.5},
    "ml16_stacking": {"r2": 0.5}, "ml17_blending": {"r2": 0.5},
}
#: Columns that are shares of a whole or scores between 0 and 1.
SHARES = {"accuracy", "precision", "recall", "f1", "importance"}


#: Same estimator as ml_fit_xgboost_regressor, a minute and a half each; run with TABLOOM_SLOW=1.
SLOW = {"ml_fit_xgboost_classifier", "fsc4_boosted_importance"}


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_are_plausible(spark, name):
    if name in SLOW and not os.environ.get("TABLOOM_SLOW"):
        pytest.skip("slow; test_boosting.py covers the estimator")
    rows = [r.asDict() for r in E.queries()[name](spark, SF_TINY).collect()]
    assert rows, name
    for r in rows:
        for c, least in FLOORS.get(name, {}).items():
            assert r[c] >= least, (name, c, r[c])
        for c in SHARES & set(r):
            assert r[c] is None or not isinstance(r[c], float) or r[c] <= 1 + 1e-9 or name.startswith("fsc"), (name, c, r[c])
        for c in ("mape", "mae", "mse", "rmse"):
            assert r.get(c) is None or r[c] >= 0, (name, c, r[c])
    if "percent" in rows[0] and rows[0]["percent"] is not None:
        assert abs(sum(r["percent"] for r in rows) - 100) < 1e-6


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["p_type", "mape", "mae", "mse", "rmse", "r2", "n"]
    assert 0 < df.count() <= 3
