"""pandas-parity, property and helper tests on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tabloom.functions import cdf
from tabloom.operators import clean, features, profile, relational, sampling, windows
from tabloom.operators.forecast import intermittent, smoothing
from tabloom.plans import fixtures as fx


# ------------------------------------------------------------------ cdf
def test_cdf_reference_values():
    assert abs(cdf.t_sf_two_sided(2.0, 10) - 0.0733880) < 1e-6
    assert abs(cdf.t_sf_two_sided(1.96, 1e6) - 0.0499958) < 1e-5
    assert abs(cdf.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(cdf.chi2_sf(10.0, 4) - 0.0404277) < 1e-6
    assert abs(cdf.f_sf(4.0, 2, 10) - 1.8 ** -5) < 1e-12  # closed form for d1 = 2
    assert abs(cdf.norm_ppf(0.975) - 1.959963985) < 1e-8
    assert abs(cdf.norm_cdf(1.0) - 0.841344746) < 1e-8


# ------------------------------------------------------------------ pandas parity
def _frame(spark):
    pdf = pd.DataFrame({"k": [1, 2, 3, 4, 5, 6, 7], "g": ["a"] * 4 + ["b"] * 3,
                        "v": [np.nan, 1.0, np.nan, 4.0, 2.0, np.nan, np.nan]})
    return pdf, spark.createDataFrame(pdf)


def test_ffill_bfill_interpolate_match_pandas(spark):
    pdf, df = _frame(spark)
    for method, fn in (("fill_forward", lambda s: s.ffill()), ("fill_backward", lambda s: s.bfill()),
                       ("interpolate", lambda s: s.interpolate())):
        got = clean.fill(df, "v", method, order_by="k", partition_by="g").orderBy("k").toPandas()["v"]
        want = pdf.groupby("g")["v"].transform(fn)
        assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True), method


def test_fill_mean_median_mode(spark):
    pdf, df = _frame(spark)
    for method, val in (("fill_mean", pdf["v"].mean()), ("fill_median", pdf["v"].median())):
        got = clean.fill(df, "v", method).orderBy("k").toPandas()["v"]
        assert np.allclose(got, pdf["v"].fillna(val))
    got = clean.fill(df, "v", "fill_mode").orderBy("k").toPandas()["v"]
    assert np.allclose(got, pdf["v"].fillna(pdf["v"].mode()[0]))


def test_describe_matches_pandas(spark):
    li = fx.load(spark, SF_TINY, "lineitem")
    got = profile.describe(li, ["l_quantity", "l_discount"]).toPandas().set_index("column")
    want = li.select("l_quantity", "l_discount").toPandas().describe().T
    for c in ("l_quantity", "l_discount"):
        for a, b in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            assert math.isclose(got.loc[c, a], want.loc[c, b], rel_tol=1e-9, abs_tol=1e-12)


def test_join_naming_matches_pandas_merge(spark):
    left = pd.DataFrame({"id": [1, 2, 3], "x": [1.0, 2.0, 3.0], "name": ["a", "b", "c"]})
    right = pd.DataFrame({"id": [2, 3, 4], "name": ["B", "C", "D"], "y": [20, 30, 40]})
    for how in ("inner", "left", "right", "outer"):
        want = left.merge(right, on="id", how=how)
        got = relational.join(spark.createDataFrame(left), spark.createDataFrame(right), how, on="id").toPandas()
        assert list(got.columns) == list(want.columns)
        assert len(got) == len(want)


def test_null_keys_match_option(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "k long, a long")
    right = spark.createDataFrame([(None, 10), (1, 20)], "k long, b long")
    assert relational.join(left, right, "inner", on="k").count() == 1
    assert relational.join(left, right, "inner", on="k", null_keys="match").count() == 2


def test_cross_join_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        relational.join(df, df, "cross", on="id")


# ------------------------------------------------------------------ properties
def test_union_count_and_difference_disjoint(spark):
    o = fx.load(spark, SF_TINY, "orders")
    d = fx.orders_dups(spark, SF_TINY)
    assert relational.combine([o, d], "union").count() == o.count() + d.count()
    m = fx.orders_missing(spark, SF_TINY)
    diff = relational.combine([o, m], "difference")
    assert diff.intersect(m).count() == 0


def test_sampling_exact_sizes(spark):
    o = fx.load(spark, SF_TINY, "orders")
    assert sampling.sample(o, n=37, key="o_orderkey").count() == 37
    big = sampling.sample(o, frac=0.3, key="o_orderkey", topk_limit=0)
    small = sampling.sample(o, frac=0.3, key="o_orderkey")
    assert big.count() == small.count() == round(0.3 * o.count())
    assert sorted(r[0] for r in big.select("o_orderkey").collect()) == \
        sorted(r[0] for r in small.select("o_orderkey").collect())
    strat = sampling.sample(o, frac=0.2, key="o_orderkey", stratify_by="o_orderpriority")
    per = o.groupBy("o_orderpriority").count().toPandas().set_index("o_orderpriority")["count"]
    got = strat.groupBy("o_orderpriority").count().toPandas().set_index("o_orderpriority")["count"]
    for k, n in per.items():
        assert abs(got.get(k, 0) - 0.2 * n) <= 1
    split = sampling.train_test_split(o, 0.25, key="o_orderkey")
    assert split.filter("is_test").count() == math.ceil(0.25 * o.count())


def test_ses_alpha_one_is_last_value(spark):
    pdf = pd.DataFrame({"s": ["x"] * 10, "t": range(10), "v": [3.0, 5, 2, 8, 1, 9, 4, 6, 7, 10]})
    out = smoothing.ses_search(spark.createDataFrame(pdf), "v", "t", ["s"], alphas=[1.0], select_on="test")
    assert out.first()["level"] == 1.0 * pdf["v"].iloc[7]


def test_croston_alpha_one_no_zeros_is_last_value(spark):
    pdf = pd.DataFrame({"s": ["x"] * 6, "t": range(6), "v": [3.0, 5, 2, 8, 1, 9]})
    out = intermittent.croston(spark.createDataFrame(pdf), "v", "t", ["s"], "croston", alpha=1.0).first()
    assert out["forecast"] == 9.0


def test_croston_search_agrees_with_fold(spark):
    dem = fx.demand_intermittent(spark, SF_TINY)
    fold = intermittent.croston(dem, "demand", "month", ["l_partkey"], "sba", alpha=0.3).toPandas()
    D = dem.toPandas().sort_values(["l_partkey", "month"])
    for key, g in list(D.groupby("l_partkey"))[:20]:
        mape, fc, _ = intermittent.croston_batch(g["demand"].to_numpy()[None, :], "sba", np.array([0.3]),
                                              np.array([np.nan]))
        row = fold[fold.l_partkey == key].iloc[0]
        if not np.isnan(mape[0, 0]):
            assert math.isclose(mape[0, 0], row["mape"], rel_tol=1e-9)
            assert math.isclose(fc[0, 0], row["forecast"], rel_tol=1e-9)


def test_health_score_of_normal_mean_is_100(spark):
    from tabloom.operators import fault
    t = fx.fault_table(spark, SF_TINY).select("l_quantity", "l_discount", "fail")
    means = t.filter("NOT fail").agg(F.avg("l_quantity"), F.avg("l_discount")).first()
    probe = spark.createDataFrame([(float(means[0]), float(means[1]), False)], t.schema)
    scored = fault.health_score(t.unionByName(probe), "fail", ["l_quantity", "l_discount"])
    # the probe row shifts the normal mean only slightly: score stays at the top
    best = scored.agg(F.max("health_score")).first()[0]
    assert best > 99.0


def test_interaction_and_time_features(spark):
    df = spark.createDataFrame([(2.0, 4.0, "2021 第3季度")], "a double, b double, t string")
    out = features.interaction(df, "r", ["a", "b"], "divide").first()
    assert out["r"] == 0.5
    tf = features.time_features(df, "t").first()
    assert (tf["year"], tf["quarter"], tf["month"]) == (2021, 3, 7)


def test_misaligned_split(spark):
    df = spark.createDataFrame([("a,b,c", None, None), ("x", "y", "z")], "c1 string, c2 string, c3 string")
    fixed, n = clean.fix_misaligned(df)
    rows = sorted(tuple(r) for r in fixed.collect())
    assert rows == [("a", "b", "c"), ("x", "y", "z")]
    assert n.first()[0] == 1


def test_aggregated_feature_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 4.0)], "g string, v double")
    out = {r["v"]: r["m"] for r in windows.aggregated_feature(df, "m", "g", "v").collect()}
    assert out[1.0] is None and out[2.0] == 3.0


def test_distributed_quantiles_match_global(spark):
    from tabloom.operators.quantiles import quantiles
    li = fx.load(spark, SF_TINY, "lineitem")
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    g = quantiles(li, cols, probs, mode="global")
    d = quantiles(li, cols, probs, mode="distributed")
    for c in cols:
        assert np.allclose(g[c], d[c], rtol=1e-12), c
    a = profile.describe(li, cols, mode="distributed").toPandas().set_index("column")
    b = profile.describe(li, cols, mode="global").toPandas().set_index("column")
    assert np.allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), rtol=1e-9)


@pytest.mark.parametrize("method", ["fill_forward", "fill_backward", "interpolate"])
def test_segmented_fill_matches_plain_window(spark, method):
    e = fx.events_gaps(spark, SF_TINY)
    plain = windows.fill_ordered(e, ["value"], method, ["ts", "event_id"], "user_id", rows_per_block=10 ** 9)
    seg = windows.fill_ordered(e, ["value"], method, ["ts", "event_id"], "user_id", rows_per_block=97)
    a = plain.select("event_id", "value").toPandas().sort_values("event_id").reset_index(drop=True)
    b = seg.select("event_id", "value").toPandas().sort_values("event_id").reset_index(drop=True)
    assert np.allclose(a["value"].to_numpy(dtype=float), b["value"].to_numpy(dtype=float), equal_nan=True)
    # one hot series: every row in the same partition key
    hot = e.withColumn("user_id", F.lit(1))
    a = windows.fill_ordered(hot, ["value"], method, ["ts", "event_id"], "user_id", rows_per_block=10 ** 9)
    b = windows.fill_ordered(hot, ["value"], method, ["ts", "event_id"], "user_id", rows_per_block=50)
    a = a.select("event_id", "value").toPandas().sort_values("event_id")["value"].to_numpy(dtype=float)
    b = b.select("event_id", "value").toPandas().sort_values("event_id")["value"].to_numpy(dtype=float)
    assert np.allclose(a, b, equal_nan=True)


def test_time_split_blocks_match_window(spark):
    e = fx.load(spark, SF_TINY, "events").select("event_id", "user_id", "ts")
    a = sampling.time_split(e, ["ts", "event_id"], 0.3, "user_id", rows_per_block=10 ** 9)
    b = sampling.time_split(e, ["ts", "event_id"], 0.3, "user_id", rows_per_block=40)
    ra = sorted((r[0], r[1]) for r in a.select("event_id", "is_test").collect())
    rb = sorted((r[0], r[1]) for r in b.select("event_id", "is_test").collect())
    assert ra == rb
    hot = e.withColumn("user_id", F.lit(7))
    a = sampling.time_split(hot, ["ts", "event_id"], 0.3, "user_id", rows_per_block=10 ** 9)
    b = sampling.time_split(hot, ["ts", "event_id"], 0.3, "user_id", rows_per_block=40)
    assert sorted(r[0] for r in a.filter("is_test").select("event_id").collect()) == \
        sorted(r[0] for r in b.filter("is_test").select("event_id").collect())


def test_stratified_histogram_path_matches_window_path(spark):
    o = fx.load(spark, SF_TINY, "orders")
    a = sampling.sample(o, frac=0.2, key="o_orderkey", stratify_by="o_orderpriority")
    old = sampling.WINDOW_LIMIT
    sampling.WINDOW_LIMIT = 0
    try:
        b = sampling.sample(o, frac=0.2, key="o_orderkey", stratify_by="o_orderpriority")
        rb = sorted(r[0] for r in b.select("o_orderkey").collect())
    finally:
        sampling.WINDOW_LIMIT = old
    assert sorted(r[0] for r in a.select("o_orderkey").collect()) == rb


def test_predicate_translation_keeps_quoted_text():
    t = relational.to_sql_predicate
    assert t("q > 30 & f in ['R', 'A']") == "q > 30 and f in ('R', 'A')"
    assert t("n == 'a & b' | x in ['c|d']") == "n == 'a & b' or x in ('c|d')"
    assert t("~(a > 1) & `my col` == True") == "not (a > 1) and `my col` == true"


def test_group_quantiles_bucketed_matches_exact(spark):
    from tabloom.operators.quantiles import group_quantiles
    li = fx.load(spark, SF_TINY, "lineitem")
    probs, names = [0.1, 0.5, 0.75], ["p10", "p50", "p75"]
    a = group_quantiles(li, "l_returnflag", "l_extendedprice", probs, names, mode="global").toPandas()
    b = group_quantiles(li, "l_returnflag", "l_extendedprice", probs, names, mode="distributed",
                        group_limit=100).toPandas()
    a, b = a.sort_values("l_returnflag").reset_index(drop=True), b.sort_values("l_returnflag").reset_index(drop=True)
    assert np.allclose(a[names].to_numpy(), b[names].to_numpy(), rtol=1e-12)
    # mixed: one group below the limit stays in bucket 0
    c = group_quantiles(li, "l_returnflag", "l_extendedprice", probs, names, mode="distributed",
                        group_limit=1700).toPandas().sort_values("l_returnflag").reset_index(drop=True)
    assert np.allclose(a[names].to_numpy(), c[names].to_numpy(), rtol=1e-12)


def test_moving_windows_block_plan_matches_window(spark):
    e = fx.load(spark, SF_TINY, "events").select("event_id", "user_id", "ts", "value")
    for fn in (lambda d, r: windows.sma(d, "value", 3, ["ts", "event_id"], "user_id", rows_per_block=r),
               lambda d, r: windows.wma(d, "value", [0.2, 0.3, 0.5], ["ts", "event_id"], "user_id",
                                        rows_per_block=r),
               lambda d, r: windows.lag_features(d, "value", 2, ["ts", "event_id"], "user_id",
                                                 rows_per_block=r)):
        a = fn(e, 10 ** 9).toPandas().sort_values("event_id").reset_index(drop=True)
        b = fn(e, 97).toPandas().sort_values("event_id").reset_index(drop=True)
        assert list(a.columns) == list(b.columns)
        num = [c for c in a.columns if c not in ("ts",)]
        assert np.allclose(a[num].to_numpy(dtype=float), b[num].to_numpy(dtype=float), equal_nan=True)


def test_forecasters_survive_short_and_flat_series(spark):
    from tabloom.operators.forecast import arima, network
    rows = [("short", t, float(v)) for t, v in enumerate([5, 7, 6, 8, 9, 7])] + \
           [("flat", t, 0.0) for t in range(30)] + \
           [("ok", t, float(10 + (t % 4) + t * 0.5)) for t in range(40)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    a = arima.arima(df, "v", "t", ["s"], (2, 1, 1)).toPandas()
    assert set(a["s"]) == {"short", "flat", "ok"}
    sm = smoothing.smoothing_search(df, "v", "t", ["s"]).toPandas()
    assert "ok" in set(sm["s"])
    cs = intermittent.croston_search(df, "v", "t", ["s"]).toPandas()
    flat = cs[cs["s"] == "flat"]                # no demand at all: kept, unscored, with a warning
    assert len(flat) and flat["mape"].isna().all() and (flat["warning"] == intermittent.ALL_ZERO).all()
    nn = network.lag_network(df, "v", "t", ["s"], input_sizes=[2], hidden_sizes=[2], epochs=5).toPandas()
    assert "ok" in set(nn["s"])


def test_join_key_type_mismatch_is_an_error(spark):
    left = spark.createDataFrame([(1, "a")], "k long, x string")
    right = spark.createDataFrame([("1", "b")], "k string, y string")
    with pytest.raises(ValueError):
        relational.join(left, right, "inner", on="k")
    ok = spark.createDataFrame([(1, "b")], "k int, y string")
    assert relational.join(left, ok, "inner", on="k").count() == 1


def test_lazy_reports(spark):
    left = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c"), (5, "d")], "k long, w string")
    res = relational.join(left, right, "inner", on="k")
    r = relational.join_report(left, right, res).first()
    assert (r["left_rows"], r["right_rows"], r["result_rows"], r["common_cols"]) == (3, 4, 2, 1)
    c = relational.combine_report([left, left], relational.combine([left, left], "union")).first()
    assert (c["n_inputs"], c["total_rows_in"], c["rows_out"], c["common_cols"]) == (2, 6, 6, 2)
    f = clean.fill_report(left, clean.fill(left, "v", "fill_mean")).first()
    assert (f["missing_before"], f["missing_after"], f["cells_filled"]) == (1, 0, 1)


def test_ranks_of_two_columns_from_one_count(spark):
    """Both columns' ranks by buckets and by one window, with ties, missing and infinite values."""
    from tabloom.operators import stats
    rows = [(i, float(i * 7 % 40) if i % 9 else None, float("nan") if i == 5 else float("inf") if i == 8 else float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    pdf = pd.DataFrame(rows, columns=["i", "a", "b"]).set_index("i")
    for small in (0, None):
        got = stats.average_ranks(df, {"a": "ra", "b": "rb"}, small).toPandas().set_index("i").sort_index()
        for c in "ab":
            np.testing.assert_array_equal(got[f"r{c}"], pdf[c].rank())
        assert list(got.columns) == ["a", "b", "ra", "rb"]
    r = stats.correlation(df.filter("b < 9"), "a", "b", "spearman", small_distinct=0).first().r
    kept = pdf[(pdf.b < 9) & pdf.a.notna()].rank()
    assert abs(r - kept.a.corr(kept.b)) < 1e-12


def test_lloyd_steps_are_those_of_kmeans(spark, monkeypatch):
    """All runs stepped together end where Spark's runs end, the cheapest is kept."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from tabloom.operators import fault
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(900, 2)) + rng.integers(0, 4, (900, 1)) * 3.0, columns=["a", "b"])
    pdf["fail"] = np.arange(900) % 3 != 0
    df = spark.createDataFrame(pdf).repartition(3).cache()
    faults = df.filter("fail")
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(faults).cache()
    whole = [KMeans(k=4, seed=s, featuresCol="f", maxIter=300).fit(vec) for s in range(4)]
    starts = [np.array(KMeans(k=4, seed=s, featuresCol="f", maxIter=0).fit(vec).clusterCenters()) for s in range(4)]
    for one, start in zip(whole, starts):
        np.testing.assert_allclose(fault.lloyd(faults.select("a", "b"), [start], 300, 1e-4), one.clusterCenters(), atol=1e-9)
    best = min(whole, key=lambda m: m.summary.trainingCost)
    centers = fault.lloyd(faults.select("a", "b"), starts, 300, 1e-4)
    # runs that reach the same clusters tie, rounding picks their numbers
    np.testing.assert_allclose(sorted(centers.tolist()), sorted(c.tolist() for c in best.clusterCenters()), atol=1e-6)
    own = fault.nearest_center([F.col("a"), F.col("b")], np.array(best.clusterCenters()))
    assert best.transform(vec).filter(own != F.col("prediction")).count() == 0
    for least in (fault.PACKED_ROWS, 0):
        monkeypatch.setattr(fault, "PACKED_ROWS", least)
        sizes = sorted(r["count"] for r in fault.fault_patterns(df, "fail", 4, ["a", "b"], seed=0, n_init=4).collect())
        assert sizes == sorted(best.summary.clusterSizes)
