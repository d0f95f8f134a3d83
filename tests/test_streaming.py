import shutil
import tempfile

from pyspark.sql import functions as F

from conftest import SF_TINY
from tabloom.streaming.quality import quality_counters


def test_quality_counters_on_stream(spark):
    src = tempfile.mkdtemp(prefix="tabloom-stream-")
    shutil.copy(f"{SF_TINY}/events.parquet", f"{src}/part-0.parquet")
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value")))
    counters = quality_counters(stream, "ts", "1 day", "1 hour", ["value", "event_type"])
    q = counters.writeStream.outputMode("complete").format("memory").queryName("dq_stream").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT sum(rows) AS r, sum(missing_value) AS m FROM dq_stream").first()
    finally:
        q.stop()
    want = batch.agg(F.count(F.lit(1)).alias("r"), F.count_if(F.col("event_id") % 5 == 0).alias("m")).first()
    assert got["r"] == want["r"]
    assert got["m"] == want["m"]


def test_frozen_health_score_on_stream(spark):
    from tabloom.operators import fault
    from tabloom.plans import fixtures as fx
    batch = fx.fault_table(spark, SF_TINY).select("l_quantity", "l_discount", "fail")
    score = fault.health_scorer(batch, "fail", ["l_quantity", "l_discount"])
    src = tempfile.mkdtemp(prefix="tabloom-stream-")
    batch.write.parquet(src + "/in")
    stream = spark.readStream.schema(batch.schema).parquet(src + "/in")
    q = score(stream).select("health_score").writeStream.format("memory").queryName("hs_stream").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT count(*) AS n, round(avg(health_score), 9) AS m FROM hs_stream").first()
    finally:
        q.stop()
    want = score(batch).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("health_score"), 9).alias("m")).first()
    assert (got["n"], got["m"]) == (want["n"], want["m"])
