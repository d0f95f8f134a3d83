import math
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabloom.functions.expressions import OperatorError
from tabloom.operators import sketches as sk


def folder():
    return tempfile.mkdtemp(prefix="tabloom-sketch-")


def rows(df):
    return sorted(map(tuple, df.collect()))


def whole(df, *args, **kw):
    return sk.merge(sk.sketch(df, *args, **kw))


def test_merged_loads_are_the_sketch_of_the_whole_table(spark):
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_discount")
    path = folder()
    for part in range(4):  # uneven loads
        sk.write_load(items.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(2 ** part + 1)) == 0 if part else F.lit(False)), path, f"p{part}")
    taken = [items.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(2 ** part + 1)) == 0) for part in range(1, 4)]
    table = taken[0].unionByName(taken[1]).unionByName(taken[2]).cache()
    got, want = sk.read_loads(spark, path), whole(table)
    assert rows(got["buckets"].select("column", "bucket", "rows")) == rows(want["buckets"].select("column", "bucket", "rows"))
    assert rows(got["registers"].select("column", "register", "level")) == rows(want["registers"].select("column", "register", "level"))
    a = {x["column"]: x for x in sk.describe_sketch(got).collect()}
    b = {x["column"]: x for x in sk.describe_sketch(want).collect()}
    for c in table.columns:
        assert a[c]["count"] == b[c]["count"] and a[c]["distinct"] == b[c]["distinct"]
        for stat in ("mean", "std", "min", "q25", "q50", "q75", "max"):
            assert a[c][stat] == (None if b[c][stat] is None else pytest.approx(b[c][stat], rel=1e-9)), (c, stat)
    # One load written again replaces itself; a choice of loads is a choice of rows.
    before = rows(got["buckets"])
    sk.write_load(taken[0], path, "p1")
    got = sk.read_loads(spark, path)
    assert rows(got["buckets"]) == before
    assert rows(sk.read_loads(spark, path, ["p2"])["buckets"]) == rows(whole(taken[1])["buckets"])
    # Error bounds against the exact values.
    values = {c: sorted(x[0] for x in table.select(c).collect()) for c in ("l_orderkey", "l_extendedprice", "l_discount")}
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for x in sk.sketch_quantiles(got, probs).collect():
        exact = values[x["column"]][math.floor(x["prob"] * (len(values[x["column"]]) - 1))]
        assert abs(x["value"] - exact) <= 0.01 * abs(exact) + 1e-12, x
    for x in sk.sketch_distinct(got).collect():
        exact = table.select(x["column"]).distinct().count()
        assert abs(x["distinct"] - exact) <= 4 * 1.04 / 128 * exact + 0.5, x


def test_distinct_counts_of_all_sizes(spark):
    for n in (1, 10, 1_000, 30_000, 200_000):
        t = spark.range(n).select((F.col("id") * 7919).alias("a"), F.lit("x").alias("b"))
        got = {x["column"]: x["distinct"] for x in sk.sketch_distinct(whole(t, precision=12), 12).collect()}
        assert got["b"] == 1 and abs(got["a"] - n) <= 4 * 1.04 / 64 * n + 0.5, (n, got)


def test_awkward_values(spark):
    inf, nan = float("inf"), float("nan")
    t = spark.createDataFrame([(x, None) for x in (-inf, -5.0, -0.001, -0.0, 0.0, None, nan, 1e-300, 3.0, 1e300, inf)], "a double, b string")
    got = {x["column"]: x for x in sk.describe_sketch(whole(t)).collect()}
    a, b = got["a"], got["b"]
    assert (a["count"], a["missing"], a["distinct"]) == (9, 2, 8)
    assert (a["min"], a["max"]) == (-inf, inf)
    assert (b["count"], b["missing"], b["distinct"], b["mean"], b["q50"]) == (0, 11, 0, None, None)
    order = [-inf, -5.0, -0.001, 0.0, 0.0, 1e-300, 3.0, 1e300, inf]
    found = {x["prob"]: x["value"] for x in sk.sketch_quantiles(whole(t), [i / 8 for i in range(9)]).collect()}
    for i, exact in enumerate(order):
        v = found[i / 8]
        assert v == exact or abs(v - exact) <= 0.01 * abs(exact)
    one = {x["column"]: x for x in sk.describe_sketch(whole(spark.createDataFrame([(2.0,)], "a double"))).collect()}["a"]
    assert (one["mean"], one["std"], one["q50"]) == (2.0, None, 2.0)
    assert sk.describe_sketch(whole(spark.createDataFrame([], "a double"))).collect() == []


def test_bad_arguments(spark):
    t = spark.createDataFrame([(1,)], "a int")
    for call in (lambda: sk.sketch(t, ["nope"]), lambda: sk.sketch(t, error=0), lambda: sk.sketch(t, precision=30),
                 lambda: sk.write_load(t, folder(), "a/b"), lambda: sk.read_loads(spark, folder() + "/none"),
                 lambda: sk.sketch_quantiles(whole(t), [2])):
        with pytest.raises(OperatorError):
            call()
