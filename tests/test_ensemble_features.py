import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError
from tabloom.operators import ensemble as ens
from tabloom.operators.forecast import intermittent as im


@pytest.mark.parametrize("build", [ens.stacking, ens.blending])
def test_use_features_leaves_the_others_out(spark, build):
    t = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    t = t.withColumn("leak", 2.0 * F.col("a") - F.col("b")).withColumn("y", F.col("leak"))
    bases = ["linear_regression", "ridge"]
    model = build(t, ["a", "b", "leak"], "y", bases, "linear_regression", key="id", use_features=["a"])
    only = build(t.drop("leak"), ["a"], "y", bases, "linear_regression", key="id")
    got = model.transform(t.drop("leak", "b")).select("id", "prediction")  # what is left out need not be there
    want = only.transform(t).select("id", F.col("prediction").alias("p"))
    assert got.join(want, "id").filter(F.abs(F.col("prediction") - F.col("p")) > 1e-9).count() == 0
    for bad in ([], ["a", "nope"]):
        with pytest.raises(OperatorError):
            build(t, ["a", "b"], "y", bases, "linear_regression", key="id", use_features=bad)


def test_croston_groups_follow_the_rows(spark, monkeypatch):
    t = spark.range(600).select((F.col("id") % 30).alias("s"), F.col("id").alias("time"), ((F.col("id") * 7) % 4).cast("double").alias("d"))
    want = im.croston(t, "d", "time", ["s"], groups=1).orderBy("s").collect()
    assert im.croston(t, "d", "time", ["s"]).orderBy("s").collect() == want
    monkeypatch.setattr(im, "ROWS_PER_GROUP", 2)  # 300 groups
    assert im.croston(t, "d", "time", ["s"]).orderBy("s").collect() == want


def test_croston_search_shares_states_bit_for_bit():
    """The states of alpha and beta kept apart give the figures of every candidate run on its own."""
    rng = np.random.default_rng(3)
    D = np.where(rng.random((40, 30)) < 0.6, 0.0, rng.integers(-1, 9, (40, 30)).astype(float))
    D[0] = 0.0
    D[1:6, 20:] = np.nan
    grid = np.arange(1, 10) / 10
    found = im.search_batch(D, im.METHODS, grid, grid[:4])
    for m in im.METHODS:
        a, b = [x.ravel() for x in np.meshgrid(grid, grid[:4], indexing="ij")] if m == "tsb" else (grid, grid)
        mape, ahead, _ = im.croston_batch(D, m, a, b)
        np.testing.assert_array_equal(found[m][0], mape)
        np.testing.assert_array_equal(found[m][1], ahead)


def test_filled_demand_is_dealt_once(spark, tmp_path):
    """Line items are shuffled by part, the months filled in are neither joined nor dealt again for the search."""
    from tabloom.plans import fixtures as fx
    spark.sql("""SELECT IF(id % 7 = 0, NULL, id % 5) AS l_partkey, CAST(id % 3 AS DOUBLE) AS l_quantity,
        IF(id % 11 = 0, NULL, timestamp_ntz'2020-01-15 00:00:00' + make_interval(0, CAST(id % 4 AS INT) * 2)) AS l_shipdate
        FROM range(60)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    dem = fx.demand_intermittent(spark, str(tmp_path))
    rows = {(r.l_partkey, r.month.month): r.demand for r in dem.collect()}
    assert len(rows) == 6 * 7 and sum(v for (p, _), v in rows.items() if p is None) == 0
    want = sum(i % 3 for i in range(60) if i % 7 and i % 11)
    assert sum(rows.values()) == want
    found = im.croston_search(dem, "demand", "month", ["l_partkey"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert found.count() == 18
