"""Small-table and large-table plans return the same rows, whatever the data."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.functions.expressions import portable_hash
from tabloom.operators import clean, importance, profile, relational, sampling, stats, windows
from tabloom.operators.forecast import arima, intermittent, network, smoothing


def bag(df):
    return Counter(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """NULL series, order and stratum keys, tied hash keys, identical rows, NaN and a column t."""
    rows = []
    for k in range(400):
        rows.append((k % 7 if k % 11 else None, k // 3 if k % 13 else None, None if k % 5 == 0 else float(k % 9),
                     "ab"[k % 2] if k % 9 else None, k, k % 3))
    rows += [(1, 2, 3.0, "a", -1, 0)] * 60
    return spark.createDataFrame(rows, "s int, o int, v double, g string, t long, dup int").cache()


@pytest.mark.parametrize("key", [None, "t", "dup", "s"])
@pytest.mark.parametrize("n", [1, 37, 200, 459])
def test_sample_is_exact_and_the_same(odd, key, n):
    small = sampling.sample(odd, n=n, key=key)
    large = sampling.sample(odd, n=n, key=key, topk_limit=0)
    assert small.count() == n
    assert bag(small) == bag(large)


@pytest.mark.parametrize("key", [None, "dup", "t"])
def test_stratified_sample(odd, key):
    small = sampling.sample(odd, frac=.25, key=key, stratify_by="g")
    large = sampling.sample(odd, frac=.25, key=key, stratify_by="g", window_limit=0)
    assert bag(small) == bag(large)
    sizes = {r.g: r["count"] for r in odd.groupBy("g").count().collect()}
    got = {r.g: r["count"] for r in large.groupBy("g").count().collect()}
    assert got == {g: round(c * .25) for g, c in sizes.items()}


@pytest.mark.parametrize("key", [None, "dup", "t", "o"])
def test_split_is_exact(odd, key):
    small = sampling.train_test_split(odd, .2, key=key)
    large = sampling.train_test_split(odd, .2, key=key, topk_limit=0)
    assert small.filter("is_test").count() == math.ceil(.2 * 460) and small.count() == 460
    assert bag(small) == bag(large)


def test_positions_and_time_split(odd):
    d = odd.filter("t >= 0")
    small = sampling.time_split(d, ["o", "t"], partition_by="s")
    large = sampling.time_split(d, ["o", "t"], partition_by="s", rows_per_block=50)
    assert bag(small) == bag(large)
    assert large.filter("is_test IS NULL").count() == 0


@pytest.mark.parametrize("method", ["fill_forward", "fill_backward", "interpolate"])
def test_fills(odd, method):
    d = odd.filter("t >= 0")
    small = windows.fill_ordered(d, "v", method, ["o", "t"], "s")
    large = windows.fill_ordered(d, "v", method, ["o", "t"], "s", rows_per_block=50)
    assert bag(small.withColumn("v", F.round("v", 9))) == bag(large.withColumn("v", F.round("v", 9)))


def test_lags_with_a_column_named_t(odd):
    d = odd.filter("t >= 0")
    for fn in (lambda **kw: windows.lag_features(d, "v", 2, ["o", "t"], "s", **kw),
               lambda **kw: windows.sma(d, "v", 3, ["o", "t"], "s", **kw)):
        assert bag(fn()) == bag(fn(rows_per_block=50))


@pytest.mark.parametrize("by", ["s", ()])
def test_text_order_keys(odd, by):
    """A text order column, as dates read from CSV files, is cut by row numbers."""
    d = odd.filter("t >= 0").withColumn("day", F.lpad(F.col("t").cast("string"), 6, "0"))
    for fn in (lambda **kw: windows.fill_ordered(d, "v", "interpolate", ["day"], by, **kw),
               lambda **kw: windows.fill_ordered(d, "v", "fill_forward", ["day"], by, **kw),
               lambda **kw: windows.lag_features(d, "v", 2, ["day"], by, **kw),
               lambda **kw: windows.sma(d, "v", 3, ["day"], by, **kw),
               lambda **kw: windows.wma(d, "v", [.2, .3, .5], ["day"], by, **kw),
               lambda **kw: sampling.time_split(d, ["day"], partition_by=by, **kw)):
        small, large = fn(), fn(rows_per_block=50)
        rounded = [F.round(c, 9).alias(c) if t == "double" else c for c, t in small.dtypes]
        assert bag(small.select(rounded)) == bag(large.select(rounded))


def test_hash_of_large_keys(spark):
    keys = [0, 5, -3, 4_000_000_000, 2 ** 62, -2 ** 62]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(portable_hash("k", 42)).collect()]
    assert got == [((k + 42) * 2654435761) % 2 ** 32 for k in keys]


def test_nan_is_missing(spark):
    nan = float("nan")
    rows = [(float(k), float(k * k), "a" if k % 2 else "b") for k in range(20)]
    plain = spark.createDataFrame(rows + [(None, 1.0, "a"), (3.5, None, "b")], "x double, y double, g string")
    holed = spark.createDataFrame(rows + [(nan, 1.0, "a"), (3.5, nan, "b")], "x double, y double, g string")
    for fn in (lambda d: profile.describe(d), lambda d: profile.describe(d, mode="distributed"),
               lambda d: profile.unique_counts(d), lambda d: profile.group_stats(d, "g", "x"),
               lambda d: stats.correlation(d, "x", "y"), lambda d: stats.correlation(d, "x", "y", "spearman"),
               lambda d: stats.correlation(d, "x", "y", "spearman", small_distinct=0),
               lambda d: stats.t_test_by_label(d, F.col("g") == "a", ["x", "y"]),
               lambda d: stats.f_regression(d, ["x"], "y"), lambda d: stats.outlier_counts(d, ["x", "y"])):
        assert bag(fn(plain)) == bag(fn(holed))
    assert stats.outliers(holed, "x", "iqr").count() == 0 == stats.outliers(holed, "x").count()
    assert bag(profile.describe(holed)) == bag(profile.describe(holed, mode="distributed"))


def test_perfect_correlation(spark):
    d = spark.createDataFrame([(float(k), -2.0 * k) for k in range(10)], "x double, y double")
    r = stats.correlation(d, "x", "y").head()
    assert abs(r.r + 1) < 1e-12 and r.p_value == 0
    f = stats.f_regression(d, ["x"], "y").head()
    assert f.p_value == 0 and f.score == float("inf")


def test_predicates_and_names(spark):
    assert relational.to_sql_predicate("a || 'x' = 'bx' | c & d") == "a || 'x' = 'bx' or c and d"
    d = spark.createDataFrame([(1, 2, 3)], ["a b", "a  b", "a_b_2"])
    names = relational.standardize_columns(d).columns
    assert len(set(names)) == 3 and names[0] == "a_b"
    assert [relational.normalize_name(x) for x in (None, "", "--", " 'Ab c' ", "x__y!")] == ["all", "all", "all", "ab_c", "x_y"]


def test_plan_follows_renames(spark):
    d = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x")], "`My Col` double, k string")
    steps = [{"column": "all", "action": "standardize_names", "auto_apply": True},
             {"column": "My Col", "action": "fill_median", "auto_apply": True},
             {"column": "gone", "action": "fill_median", "auto_apply": True}]
    out, summary = clean.apply_plan(d, steps)
    assert out.columns == ["my_col", "k"] and out.filter("my_col IS NULL").count() == 0
    assert summary.head().steps_applied == 2


def test_permutation_is_a_shuffle(spark):
    d = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    seen = set()
    for seed in range(4):
        out = importance.permute_column(d, "v", seed, key="k").orderBy("k").collect()
        assert sorted(r.v for r in out) == [float(x) for x in range(2000)]
        shift = Counter(int(r.v - r.k) % 2000 for r in out)
        assert shift.most_common(1)[0][1] < 20
        seen.add(tuple(r.v for r in out[:5]))
    assert len(seen) == 4


def test_forecasts_of_odd_series(spark):
    rows = [("short", 1, 1.0), ("short", 2, 2.0)] + [("zero", k, 0.0) for k in range(30)]
    rows += [(None, k, float(k % 4)) for k in range(30)] + [("x", k, float(k % 4)) for k in range(30)]
    rows += [("gap", k, None if k % 6 == 0 else 5.0 + k % 3) for k in range(30)]
    d = spark.createDataFrame(rows, "s string, time int, v double")
    one = {r.s: r for r in intermittent.croston(d, "v", "time", "s", "sba", .2).collect()}
    assert set(one) == {"short", "zero", None, "x", "gap"}
    assert one[None].mape == one["x"].mape and one["zero"].mape is None
    found = intermittent.croston_search(d, "v", "time", "s", extra_periods=2).collect()
    assert {r.s for r in found if r.warning == intermittent.ALL_ZERO} == {"zero"}
    assert all(len(r.future) == 2 and len(r.predicted) == len(r.actual) for r in found if r.s == "x")
    assert sum(r.is_best for r in found) == 4
    sm = smoothing.smoothing_search(d, "v", "time", "s", extra_periods=2).collect()
    assert {(r.s, r.method) for r in sm if r.warning} >= {("short", "double"), ("short", "triple"), ("zero", "triple")}
    assert all(r.mae is not None for r in sm if r.s == "gap")
    out = {r.s: r for r in arima.arima(d, "v", "time", "s").collect()}
    assert out["short"].error and out["gap"].error is None
    net = network.lag_network(d.filter("s = 'x'"), "v", "time", "s", input_sizes=[2], hidden_sizes=[2], epochs=2, extra_periods=3)
    assert [len(r.future) for r in net.collect()] == [3]
    for fn in (arima.arima, network.lag_network, intermittent.croston_search):
        with pytest.raises(ValueError):
            fn(d, "v", "time")
