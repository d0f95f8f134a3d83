"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _default_memory() -> str:
    """Local runs: 60 % of physical memory, at most 16 GB (cluster runs set it)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2 ** 30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_spark(master: str | None = None, app: str = "tabloom",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on.

    On a cluster the master and memory come from spark-submit; the defaults
    here only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(_DEFAULTS)
    if master:  # otherwise spark-submit's master (or pyspark's local default) applies
        builder = builder.master(master)
        if master.startswith("local["):
            settings["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", _default_memory())
            settings["spark.sql.shuffle.partitions"] = "8"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster configuration names a shared folder. A local session without
    one gets a folder of its own; on a cluster a missing setting is an error,
    because executors do not share the driver's folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tabloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for a written table, below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise ``df`` reliably (survives executor loss) and cut lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
