"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import sys
import time
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import checkpoint_dir

REGISTRY: dict[str, tuple] = {}

#: White space of the word and line rules: space and U+0009 to U+000D.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` with its oracle SQL."""
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query name {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabloom-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and gives the optimizer true sizes."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_path(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """Uniform non-negative 63-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def bucket_of(u: Column, n: Column) -> Column:
    """Bucket 0..n-1 of a 63-bit hash, non-decreasing in the hash."""
    return F.least((u.cast("double") / F.lit(float(2 ** 63)) * n).cast("long"), n.cast("long") - 1)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used, before
    a step that writes much itself. Handles on the Python side go first; Spark
    cleans up after a collection in a thread of its own, so it gets a moment."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def worker_state() -> dict:
    """What a Python worker keeps over its tasks. Functions travel by value, so
    their own globals are built anew for every task."""
    return sys.modules.setdefault("_tabloom_worker_state", types.ModuleType("_tabloom_worker_state")).__dict__
