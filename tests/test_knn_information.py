"""Nearest-neighbour mutual information against estimators over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError
from tabloom.operators import knn_information as K

GAMMA = 0.57721566490153286


def psi(n):
    return -GAMMA + sum(1 / j for j in range(1, int(n)))


def plain_discrete(x, y, k=3):
    rows = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    rows = [r for r in rows if sum(b == r[1] for _, b in rows) > 1]
    total, out = len(rows), 0.0
    for i, (a, b) in enumerate(rows):
        same = sorted(abs(u - a) for j, (u, v) in enumerate(rows) if v == b and j != i)
        near = min(k, len(same))
        d = same[near - 1]
        m = sum(abs(u - a) < d for u, _ in rows) if d else sum(u == a for u, _ in rows)
        out += psi(near) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(total) + out / total)


def plain_continuous(x, y, k=3):
    x, y = np.array(x), np.array(y)
    out = 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        out += sum(psi((v < d).sum() if d else (v == 0).sum()) for v in (dx, dy))
    return max(0.0, psi(len(x)) + psi(k) - out / len(x))


def sample(n=500, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = r.choice("aabc")
        a = r.gauss("abc".index(y), 0.7)
        rows.append((i, a, r.gauss(0, 1), float(r.randint(0, 6)), a * a + r.gauss(0, .3), y))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sample(), "i long, a double, b double, c double, z double, y string").cache()


def scores(df):
    return {r.feature: r.score for r in df.collect()}


def test_digamma(spark):
    got = spark.range(1, 200).select("id", K.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-12 for r in got)


@pytest.mark.parametrize("block", [K.LINE_BLOCK, 37])
def test_discrete_target(table, monkeypatch, block):
    rows = table.collect()
    p = K.points(table, ["a", "b", "c"], "y", True, False, 0, None)
    got = {r.f: r.score for r in K.discrete_scores(p, 3, block).collect()}
    for f, name in enumerate("abc"):
        assert abs(got[f] - plain_discrete([r[name] for r in rows], [r.y for r in rows])) < 1e-9
    assert got[0] > 0.3 > got[1]


@pytest.mark.parametrize("cell", [K.CELL, 20])
def test_continuous_target(table, cell):
    rows = table.collect()
    # of equal distances without noise only rounding decides: c is left to the noise below
    p = K.points(table, ["a", "b"], "z", False, False, 0, None)
    got = {r.f: r.score for r in K.continuous_scores(p, 3, cell).collect()}
    y = np.array([r.z for r in rows]) / np.std([r.z for r in rows])
    for f, name in enumerate("ab"):
        x = np.array([r[name] for r in rows])
        assert abs(got[f] - plain_continuous(x / x.std(), y)) < 1e-9
    assert got[0] > got[1]


@pytest.mark.parametrize("classification", [True, False])
def test_noise_breaks_ties_the_same_way(table, classification):
    target = "y" if classification else "z"
    p = [(r.f, r.x, r.y) for r in K.points(table, ["c"], target, classification, True, 42, ["i"]).collect()]
    plain = (plain_discrete if classification else plain_continuous)([x for _, x, _ in p], [y for _, _, y in p])
    for df in (table, table.repartition(5)):
        assert abs(scores(K.mutual_info_knn(df, ["c"], target, classification, key="i"))["c"] - plain) < 1e-9


def test_missing_rare_and_empty(spark):
    rows = [(float(i) if i % 5 else None, "u" if i == 1 else None if i % 7 == 0 else "st"[i % 2], float("nan") if i == 9 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y string, one double")
    got = scores(K.mutual_info_knn(df, ["x", "one"], "y", noise=False))
    keep = [(x, y) for x, y, _ in rows if x is not None and y is not None]
    assert abs(got["x"] - plain_discrete([x for x, _ in keep], [y for _, y in keep])) < 1e-9
    assert got["one"] is not None
    none = spark.createDataFrame([], "x double, y string")
    assert scores(K.mutual_info_knn(none, ["x"], "y")) == {"x": None}
    assert scores(K.mutual_info_knn(none.withColumn("y", F.lit(1.0)), ["x"], "y", classification=False)) == {"x": None}
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert scores(K.mutual_info_knn(few, ["x"], "y", classification=False)) == {"x": None}
    with pytest.raises(OperatorError):
        K.mutual_info_knn(few, ["x"], "y", neighbours=0)


def test_tiles_get_every_neighbour_and_few_other_points(spark):
    """Values in narrow groups: a tile gets its neighbours from around it, not every tile of the group."""
    r = np.random.default_rng(4)
    n = 3000
    x, y = r.integers(0, 3, n) + r.normal(size=n) * 1e-9, r.random(n) * 3
    d, nx, ny = K.k_nearest(x, y, n, 3)
    far = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(far, np.inf)
    np.testing.assert_array_equal(d, np.sort(far, axis=1)[:, 2])
    np.testing.assert_array_equal(np.maximum(np.abs(nx - x), np.abs(ny - y)), d)
    q = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3).cache()
    assert abs(K.plane_score(q, 3, 150) - plain_continuous(x, y)) < 1e-9
    plane = K.Plane(x, y, n, 150)
    plane.known([tuple(v) for v in q.mapInArrow(plane.bounds, "kind int, id long, n long, x0 double, x1 double, y0 double, y1 double")
                .groupBy("kind", "id").agg(F.sum("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).collect()], 3)
    dealt = q.mapInArrow(plane.dealt, "tile long, own binary, around binary").selectExpr("sum(length(own)) / 16 AS own", "sum(length(around)) / 16 AS around").first()
    assert dealt.own == n and dealt.around < 4 * n  # 20 tiles


def flat_sample(kind, n, r):
    if kind == "lines":  # a few values that noise tells apart
        return r.integers(0, 9, n) / 3 + r.normal(size=n) * 1e-10, r.random(n) * 4
    if kind == "copies":
        return r.integers(0, 9, n) / 3 + r.normal(size=n) * 1e-10, r.integers(0, 12, n) / 3 + r.normal(size=n) * 1e-10
    if kind == "equal":
        return r.integers(0, 4, n) / 4, r.integers(0, 30, n) / 4
    if kind == "far":  # most points close together, some far away
        return np.exp(r.normal(size=n) * 6), r.standard_cauchy(n)
    return r.normal(size=n), np.full(n, 2.0) if kind == "line" else r.normal(size=n)


@pytest.mark.parametrize("kind", ["plane", "line", "lines", "copies", "equal", "far"])
@pytest.mark.parametrize("n,own,k", [(4, 4, 3), (37, 20, 3), (2000, 1500, 3), (700, 700, 1), (900, 900, 17)])
def test_search_finds_the_kth_neighbour(kind, n, own, k):
    if k >= n:
        return
    x, y = flat_sample(kind, n, np.random.default_rng(n))
    d, nx, ny = K.k_nearest(x, y, own, k)
    far = np.maximum(np.abs(x[:own, None] - x), np.abs(y[:own, None] - y))
    far[np.arange(own), np.arange(own)] = np.inf
    np.testing.assert_array_equal(d, np.sort(far, axis=1)[:, k - 1])
    np.testing.assert_array_equal(np.maximum(np.abs(nx - x[:own]), np.abs(ny - y[:own])), d)


@pytest.mark.parametrize("kind", ["lines", "copies", "far"])
def test_scores_of_close_and_far_values(spark, kind):
    x, y = flat_sample(kind, 2500, np.random.default_rng(8))
    q = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3).cache()
    want = plain_continuous(x, y)
    assert abs(K.plane_score(q, 3, 100) - want) < 1e-9
    assert abs(K.plane_score(q, 3) - want) < 1e-9


def test_tiles_do_not_cut_values_that_differ_by_noise(spark):
    """A tile of a line would need all points of the other half around its own; and leaves report once."""
    x, y = flat_sample("lines", 6000, np.random.default_rng(5))
    q = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").coalesce(1).cache()
    plane = K.Plane(x, y, len(x), 300)
    K_RUN, K.RUN = K.RUN, 1000
    try:
        ends = list(plane.bounds(q.toArrow().to_batches(500)))
    finally:
        K.RUN = K_RUN
    rows = [tuple(v) for b in ends for v in zip(*b.to_pydict().values())]
    assert len({r[:2] for r in rows}) == len(rows)
    plane.known(rows, 3)
    dealt = q.mapInArrow(plane.dealt, "tile long, own binary, around binary").selectExpr("sum(length(own)) / 16 AS own", "sum(length(around)) / 16 AS around").first()
    assert dealt.own == len(x) and dealt.around < len(x) / 2


def test_values_made_ready_are_not_left_behind(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "scratch_path", lambda session, name: str(tmp_path / name))
    assert scores(K.mutual_info_knn(table, ["a", "b"], "z", classification=False, key="i"))["a"] > 0.3
    assert not list(tmp_path.iterdir())


def test_missing_values_leave_their_feature_only(spark, table, monkeypatch):
    """Runs with and without missing values, of features and of the target."""
    monkeypatch.setattr(K, "RUN", 40)
    gaps = table.select("i", F.expr("CASE WHEN i % 3 > 0 OR i > 300 THEN a END AS a"), F.expr("CASE WHEN i % 5 = 0 THEN double('nan') ELSE b END AS b"),
                        F.lit(None).cast("double").alias("none"), F.expr("CASE WHEN i % 7 > 0 OR i < 90 THEN z END AS z"))
    got = scores(K.mutual_info_knn(gaps, ["a", "none", "b"], "z", classification=False, key="i"))
    assert got["none"] is None
    p = K.points(gaps, ["a", "none", "b"], "z", False, True, 42, "i").collect()
    for f, name in ((0, "a"), (2, "b")):
        rows = [(r.x, r.y) for r in p if r.f == f]
        assert abs(got[name] - plain_continuous([x for x, _ in rows], [y for _, y in rows])) < 1e-9
