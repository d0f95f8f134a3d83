"""Deep pages (SRC-6, SRT-2): a sorted copy of a table with an index of its files.

``orderBy().offset()`` sorts the table again for every page and walks over all
rows before it. A paged copy is sorted once: rows are dealt to key ranges, each
range is sorted in its task and written in files of at most ``rows_per_file``
rows. The index has one row per file with the position of its first row, so a
page opens only the files that hold it, however deep it lies.

Order and ties: keys ascend, NULL first; rows with equal keys follow a hash of
the whole row, equal rows are interchangeable. A key value (or one repeated row)
that holds a third of the table is spread over several ranges by that hash and
by the number of the input partition, so no task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, as_list, qcol, require_columns

ROWS_PER_FILE = 1_000_000
_HASH, _PART = "__tb_hash", "__tb_part"


def _order(keys) -> list:
    return [qcol(k) for k in keys] + [F.col(_HASH), F.col(_PART)]


def write_paged(df: DataFrame, path: str, order_by, rows_per_file: int = ROWS_PER_FILE,
                n_rows: int | None = None) -> str:
    """Write ``df`` to ``path`` in the order of ``order_by``, with its index.

    ``n_rows`` saves the count where the caller knows it; it only sets the number
    of ranges. The index is written last: a copy without one is not complete and
    :func:`read_page` refuses it. An empty table gives an empty copy.
    """
    keys = as_list(order_by)
    require_columns(df, keys)
    if not keys:
        raise OperatorError("a paged copy needs order_by")
    if rows_per_file < 1:
        raise OperatorError("rows_per_file must be at least 1")
    spark = df.sparkSession
    n = df.count() if n_rows is None else n_rows
    # Ranges come from a sample, so their sizes differ: at two thirds of a file on average they need no
    # second, small file, and a page does not lie across three.
    ranges = 1 if n <= rows_per_file else -(-3 * n // (2 * rows_per_file))
    # The partition number is a function of the input split, so a task that runs
    # again deals its rows as before.
    tagged = df.select("*", F.xxhash64(*[qcol(c) for c in df.columns]).alias(_HASH),
                       F.spark_partition_id().alias(_PART))
    tagged.repartitionByRange(ranges, *_order(keys)).sortWithinPartitions(*_order(keys)) \
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    place = F.struct(*_order(keys))
    files = spark.read.parquet(f"{path}/rows") \
        .select(F.col("_metadata.file_name").alias("file"), place.alias("place")) \
        .groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"))
    # One row per file: rows / rows_per_file of them, so one task numbers them.
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return path


def _index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("file string, rows bigint, start bigint").parquet(f"{path}/index")
    except Exception as e:
        raise OperatorError(f"no paged copy at {path}") from e


def page_total(spark: SparkSession, path: str) -> int:
    """Number of rows of a paged copy, from the index alone."""
    return int(_index(spark, path).agg(F.sum("rows")).head()[0] or 0)


def page_files(spark: SparkSession, path: str, skip: int, limit: int) -> list:
    """(file, position of its first row) of the files that hold the page."""
    hit = _index(spark, path).filter((F.col("start") < skip + limit) & (F.col("start") + F.col("rows") > skip))
    return [(x["file"], x["start"]) for x in hit.orderBy("start").collect()]


def read_page(spark: SparkSession, path: str, skip: int = 0, limit: int = 100, position: str | None = None,
              descending: bool = False) -> DataFrame:
    """``limit`` rows after ``skip`` rows of the copy's order, in that order.

    ``descending`` counts and returns them from the end. ``position`` names a
    column for the row's position (from 0, in the direction asked for). A page
    past the end is empty.
    """
    if skip < 0 or limit < 0:
        raise OperatorError("skip and limit must not be negative")
    total = page_total(spark, path)
    lo, hi = min(skip, total), min(skip + limit, total)
    if descending:
        lo, hi = total - hi, total - lo
    found = page_files(spark, path, lo, hi - lo) if hi > lo else []
    if found:
        rows = spark.read.parquet(*[f"{path}/rows/{name}" for name, _ in found])
    else:
        rows = spark.read.parquet(f"{path}/rows").limit(0)
    keep = [c for c in rows.columns if c not in (_HASH, _PART)]
    if position is not None and position in keep:
        raise OperatorError(f"position column {position!r} is a column of the table")
    placed = rows.select(*[qcol(c) for c in keep], F.col("_metadata.file_name").alias("__tb_file"),
                         F.col("_metadata.row_index").alias("__tb_row"))
    starts = spark.createDataFrame(found, "__tb_file string, __tb_start bigint")
    at = F.col("__tb_start") + F.col("__tb_row")
    out = placed.join(F.broadcast(starts), "__tb_file") \
        .select(*[qcol(c) for c in keep], (F.lit(total - 1) - at if descending else at).alias("__tb_at"))
    first = total - hi if descending else lo
    out = out.filter(F.col("__tb_at").between(first, first + (hi - lo) - 1)).orderBy("__tb_at")
    return out.withColumnRenamed("__tb_at", position) if position is not None else out.drop("__tb_at")
