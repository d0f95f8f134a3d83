import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from tabloom.functions.expressions import OperatorError
from tabloom.operators import clean, features, ml, relational
from tabloom.operators.forecast.smoothing import ses_search
from tabloom.streaming.state import run_available, smooth_stream

FIELDS = "k string, at timestamp, v double"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def folder(name):
    return tempfile.mkdtemp(prefix=f"tabloom-{name}-")


def minutes(*rows):
    return [(k, DAY + dt.timedelta(minutes=m), v) for k, m, v in rows]


def recursion(rows, alpha):
    """Plain recursion over the rows in time order: (k, time, n, forecast, level)."""
    out, level, count = [], {}, {}
    for k, at, v in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (x[1], x[2])):
        old = level.get(k)
        level[k] = v if old is None else alpha * v + (1 - alpha) * old
        count[k] = count.get(k, 0) + 1
        out.append((k, at.replace(tzinfo=None), count[k], old, level[k]))
    return out


def near(got, want):
    key = lambda x: (x[0] is None, x[0] or "", x[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want):
        assert (a[3] is None) == (b[3] is None)
        assert a[4] == pytest.approx(b[4], abs=1e-9) and (a[3] or 0) == pytest.approx(b[3] or 0, abs=1e-9)


def found(spark, path):
    rows = spark.read.parquet(path).select("k", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("t"), "n", "forecast", "level")
    return [(x["k"], dt.datetime.fromisoformat(x["t"]), x["n"], x["forecast"], x["level"]) for x in rows.collect()]


def add(spark, rows, src):
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(src)


def test_smoothing_equals_batch_over_restarts_and_disorder(spark):
    src, out, ck = folder("in") + "/t", folder("out") + "/t", folder("ck")
    first = minutes(("a", 0, 1.0), ("b", 3, 5.0), ("a", 9, 4.0), ("a", 7, 2.0), (None, 4, 8.0), ("a", 7, 1.5), ("b", 5, None), ("b", 6, float("nan")))
    second = minutes(("a", 8, 3.0), ("b", 10, 6.0), ("a", 12, 7.0), (None, 11, 9.0), ("c", 12, 1.0))
    flush = minutes(("z", 10_000, 0.0))
    for part in (first, second, flush):
        add(spark, part, src)
        stream = smooth_stream(spark.readStream.schema(FIELDS).parquet(src), "v", "at", "k", alpha=0.4, watermark="5 minutes")
        run_available(stream, out, ck)  # every part is a run of its own
    rows = [x for x in first + second if x[2] is not None and x[2] == x[2]]
    near(found(spark, out), recursion(rows, 0.4))
    held_out = minutes(("b", 10_001, 0.0))
    batch = ses_search(spark.createDataFrame([x for x in rows if x[0] == "b"] + held_out, FIELDS),
                       "v", "at", "k", alphas=[0.4], test_size=0.3, select_on="test", plan="series").head()
    last = max((x for x in found(spark, out) if x[0] == "b"), key=lambda x: x[2])
    assert last[4] == pytest.approx(batch["level"], abs=1e-9)


def test_smoothing_of_events_in_many_small_batches(spark):
    events = spark.read.parquet(f"{SF_TINY}/events.parquet") \
        .select(F.col("event_type").alias("k"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("v"))
    src, out, ck = folder("in") + "/t", folder("out") + "/t", folder("ck")
    events.repartitionByRange(5, "at").write.parquet(src)
    # A delay beyond the whole span: files may come in any order.
    stream = smooth_stream(spark.readStream.option("maxFilesPerTrigger", 2).schema(FIELDS).parquet(src), "v", "at", "k", 0.2, "20000 days")
    run_available(stream, out, ck)
    assert found(spark, out) == []
    add(spark, [("z", dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc), 0.0)], src)
    run_available(smooth_stream(spark.readStream.schema(FIELDS).parquet(src), "v", "at", "k", 0.2, "20000 days"), out, ck)
    rows = [(x["k"], dt.datetime.fromisoformat(x["t"]), x["v"])
            for x in events.select("k", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("t"), "v").collect()]
    got = [x for x in found(spark, out) if x[0] != "z"]
    near(got, recursion(rows, 0.2))


def test_smoothing_bad_arguments(spark):
    stream = spark.readStream.schema(FIELDS).parquet(folder("in"))
    for call in (lambda: smooth_stream(stream, "v", "at", []), lambda: smooth_stream(stream, "v", "at", "k", alpha=0.0),
                 lambda: smooth_stream(stream, "nope", "at", "k")):
        with pytest.raises(OperatorError):
            call()


def test_last_row_per_series_over_a_restart(spark):
    src, out, ck = folder("in") + "/t", folder("out") + "/t", folder("ck")
    parts = [minutes(("a", 5, 1.0), ("b", 2, 2.0), ("a", 1, 3.0)), minutes(("a", 3, 4.0), ("b", 9, 5.0), ("c", 1, None))]
    for part in parts:
        add(spark, part, src)
        latest = relational.last_per_group(spark.readStream.schema(FIELDS).parquet(src), "at", "k")
        latest.writeStream.outputMode("complete").option("checkpointLocation", ck).trigger(availableNow=True) \
            .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start().awaitTermination()
    want = relational.last_per_group(spark.read.parquet(src), "at", "k")
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def through_stream(spark, make, name):
    src = folder("in") + "/t"
    spark.read.parquet(f"{SF_TINY}/orders.parquet").repartition(3).write.parquet(src)
    batch = spark.read.parquet(src)
    out, ck = folder("out") + "/t", folder("ck")
    run_available(make(spark.readStream.option("maxFilesPerTrigger", 1).schema(batch.schema).parquet(src)), out, ck)
    key = lambda x: tuple(map(str, x))
    got, want = spark.read.parquet(out), make(batch)
    assert got.columns == want.columns, name
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())), name
    assert got.count() > 0, name


def test_stateless_operators_on_streams(spark):
    steps = {
        "PRJ-1": lambda t: relational.project(t, include=["o_orderkey", "o_totalprice"]),
        "PRJ-2": lambda t: relational.query(t, "o_totalprice > 100000 & o_orderstatus in ['F', 'O']"),
        "PRJ-3": lambda t: relational.create_column(t, "kilo", "o_totalprice / 1000"),
        "PRJ-5": lambda t: relational.apply_mapping(t, {"o_orderkey": "id", "none": "x"}),
        "PRJ-6": lambda t: relational.standardize_columns(t.withColumnRenamed("o_orderkey", "Order Key!")),
        "CLN-2": lambda t: clean.fix_misaligned(t, ["o_orderpriority"], pattern="-")[0],
        "CLN-10": lambda t: clean.clip(t, "o_totalprice", 50_000.0, 200_000.0),
        "CLN-11": lambda t: clean.cast_column(t, "o_orderkey", "string"),
        "FE-1": lambda t: features.interaction(t, "product", ["o_totalprice", "o_custkey"], "multiply"),
        "FE-4": lambda t: features.interaction(t, "ratio", ["o_totalprice", "o_custkey"], "divide"),
        "FE-9": lambda t: features.time_parts(t, "o_orderdate"),
    }
    # One stream for all of them in a row, and the two that change names apart.
    last = ("PRJ-1", "PRJ-6", "PRJ-5")

    def chain(t):
        for name, step in steps.items():
            t = t if name in last else step(t)
        return t

    through_stream(spark, chain, "chain")
    through_stream(spark, lambda t: steps["PRJ-6"](steps["PRJ-1"](t)), "names")


def test_fitted_model_and_encoder_on_a_stream(spark):
    orders = spark.read.parquet(f"{SF_TINY}/orders.parquet")
    fitted = ml.fit_model(orders, ["o_custkey", "o_orderkey"], "o_totalprice", "linear_regression")
    _, encoder = features.label_encode(orders, "o_orderpriority")
    through_stream(spark, lambda t: ml.predict(fitted, encoder.transform(t), keep=["o_orderkey", "o_orderpriority_code"]), "ML-11")


def test_rows_leave_in_parts(spark, tmp_path, monkeypatch):
    """A long series is folded as packed numbers and leaves in parts of bounded size."""
    from tabloom.streaming import state
    assert "array" not in state._STATE
    monkeypatch.setattr(state, "ROWS_OUT", 7)
    src = spark.range(60).selectExpr("'k' k", "timestamp_seconds(1700000000 + id * 60) t", "cast(id % 9 as double) v")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    state.run_available(state.smooth_stream(stream, "v", "t", "k", 0.5, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    level, want = None, []
    for i in range(len(got)):
        before, level = level, float(i % 9) if level is None else 0.5 * level + 0.5 * (i % 9)
        want.append((i + 1, before, level))
    assert len(got) >= 49 and [(r.n, r.forecast) for r in got[:1]] == [(1, None)]
    assert all(r.n == n and abs(r.level - v) < 1e-9 and (b is None or abs(r.forecast - b) < 1e-9) for r, (n, b, v) in zip(got, want))
