import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabloom.functions.expressions import OperatorError
from tabloom.sources.catalog import Catalog
from tabloom.sources.paged import page_files, page_total, read_page, write_paged


def folder():
    return tempfile.mkdtemp(prefix="tabloom-paged-") + "/copy"


def names(rows):
    return [tuple(x) for x in rows.collect()]


def test_deep_page_opens_two_files_at_most(spark):
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    path = write_paged(items, folder(), order, rows_per_file=700)
    want = sorted(names(items), key=lambda x: (x[2], x[0], x[1]))
    assert page_total(spark, path) == len(want)
    for skip in (0, 699, 700, 10_000, len(want) - 50):
        got = read_page(spark, path, skip, 100)
        assert names(got) == want[skip:skip + 100]
        assert len(got.inputFiles()) <= 2
    # A page longer than a file takes the files that it covers.
    assert names(read_page(spark, path, 350, 3_000)) == want[350:3_350]
    back = read_page(spark, path, 10_000, 100, position="at", descending=True)
    assert [x[:3] for x in names(back)] == want[::-1][10_000:10_100]
    assert [x["at"] for x in back.collect()] == list(range(10_000, 10_100))


def test_hot_key_is_spread_and_files_stay_small(spark):
    rows = spark.range(9_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 5).alias("v"))
    path = write_paged(rows, folder(), "k", rows_per_file=500)
    sizes = [x["rows"] for x in spark.read.parquet(f"{path}/index").collect()]
    assert sum(sizes) == 9_000 and max(sizes) <= 500
    pages = [read_page(spark, path, at, 1_000, position="at").collect() for at in range(0, 9_000, 1_000)]
    seen = [x for p in pages for x in p]
    assert [x["at"] for x in seen] == list(range(9_000))
    keys = [x["k"] for x in seen]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or ""))
    assert sorted((x["k"] or "", x["v"]) for x in seen) == sorted((x["k"] or "", x["v"]) for x in rows.collect())


def test_equal_rows_in_several_files(spark):
    rows = spark.range(2_000, numPartitions=4).select(F.lit(1).alias("a"))
    path = write_paged(rows.unionByName(spark.range(3).select((F.col("id") - 1).cast("int").alias("a"))), folder(), "a", 300)
    everything = names(read_page(spark, path, 0, 5_000))
    assert everything == [(-1,), (0,)] + [(1,)] * 2_001


def test_empty_table_past_the_end_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "a int, b string")
    path = write_paged(empty, folder(), "a")
    assert page_total(spark, path) == 0
    assert read_page(spark, path, 0, 10).columns == ["a", "b"] and names(read_page(spark, path, 0, 10)) == []
    one = write_paged(spark.createDataFrame([(1, None)], "a int, b string"), folder(), "a")
    assert names(read_page(spark, one, 0, 0)) == [] and names(read_page(spark, one, 5, 5)) == []
    assert page_files(spark, one, 0, 1)[0][1] == 0
    for call in (lambda: write_paged(empty, folder(), []), lambda: write_paged(empty, folder(), "nope"),
                 lambda: read_page(spark, folder()), lambda: read_page(spark, one, -1, 2),
                 lambda: read_page(spark, one, 0, 1, position="a")):
        with pytest.raises(OperatorError):
            call()


def test_catalog_pages(spark):
    cat = Catalog(spark)
    did = cat.create(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string"), "t")
    assert [x["v"] for x in cat.page(did, 1, 2, order_by="k").collect()] == ["b", "c"]
    with pytest.raises(OperatorError):
        cat.page(did, 0, 1)
    cat.write_pages(did, folder(), "k")
    assert [x["v"] for x in cat.page(did, 1, 2).collect()] == ["b", "c"]
    cat.rename(did, "u")
    assert [x["v"] for x in cat.page("u", 0, 1).collect()] == ["a"]
