"""Operators with state per series on streaming DataFrames.

A series keeps its smoothing level and the rows that the watermark has not
passed. Only rows at or below the watermark are folded, in time order (equal
times by value), so the result is that of the batch recursion whatever the
arrival order and the cut into micro-batches. State per series is one level and
the rows of the watermark's delay. Rows that come later than the watermark are
dropped by Spark, as in any windowed aggregate; rows after the last watermark
stay in the state until later rows move it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tabloom.functions.expressions import OperatorError, as_list, present, qcol, require_columns

#: Waiting rows are packed, 8 bytes a number: lists of Python numbers take ten times that.
_STATE = "level double, n bigint, times binary, vals binary"
ROWS_OUT = 50_000


def smooth_stream(stream: DataFrame, target: str, time_column: str, series_keys, alpha: float = 0.3,
                  watermark: str = "1 hour") -> DataFrame:
    """FCT-3 on a stream: single smoothing per series, one row per observation
    once the watermark has passed it.

    Returns the keys, ``time``, ``value``, ``n`` (observations so far),
    ``forecast`` (the level before the observation, NULL for the first) and
    ``level``. Rows with a missing value or time are left out; a NULL key is a
    series of its own.
    """
    keys = as_list(series_keys)
    require_columns(stream, keys + [target, time_column])
    if not keys:
        raise OperatorError("a stream needs series_keys: one series would be one task")
    if not 0 < alpha <= 1:
        raise OperatorError("alpha must be in (0, 1]")
    names = [f"__tb_k{i}" for i in range(len(keys))]
    rows = stream.select(*[qcol(k).alias(n) for k, n in zip(keys, names)], qcol(time_column).cast("timestamp").alias("__tb_time"),
                         present(stream, target).cast("double").alias("value")) \
        .filter(F.col("value").isNotNull() & F.col("__tb_time").isNotNull()) \
        .withWatermark("__tb_time", watermark).withColumn("__tb_us", F.unix_micros("__tb_time"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"{n} {types[n]}" for n in names) + ", us bigint, value double, n bigint, forecast double, level double"

    at_once = ROWS_OUT

    def fold(key, frames, state):
        level, n, times, values = state.get if state.exists else (None, 0, b"", b"")
        times, values = [np.frombuffer(times, "<i8")], [np.frombuffer(values, "<f8")]
        if not state.hasTimedOut:
            for frame in frames:
                times.append(frame["__tb_us"].to_numpy("<i8", copy=True))
                values.append(frame["value"].to_numpy("<f8", copy=True))
        times, values = np.concatenate(times), np.concatenate(values)
        order = np.lexsort((values, times))
        times, values = times[order], values[order]
        del order
        mark = state.getCurrentWatermarkMs()
        done = int(np.searchsorted(times, mark * 1000, side="right"))
        rest = times[done:].tobytes(), values[done:].tobytes()
        first = int(times[done]) if done < len(times) else None
        times, values = times[:done], values[:done]
        if done:
            start = [] if level is None else [level]
            levels = pd.Series(np.concatenate([start, values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            before = np.concatenate([[np.nan], levels[:-1]])[len(start):]
            levels = levels[len(start):]
            for i in range(0, done, at_once):
                part = slice(i, min(i + at_once, done))
                columns = {name: [k] * (part.stop - i) for name, k in zip(names, key)}
                columns.update(us=times[part], value=values[part], n=np.arange(n + i + 1, n + part.stop + 1),
                               forecast=before[part], level=levels[part])
                result = pd.DataFrame(columns)
                if np.isnan(before[i]):  # the first of a series
                    result["forecast"] = result["forecast"].astype(object).where(result["forecast"].notna(), None)
                yield result
            level, n = float(levels[-1]), n + done
        state.update((level, n, *rest))
        if first is not None:  # called again, rows or none, when the watermark reaches the first that waits
            state.setTimeoutTimestamp(max(mark, -(-first // 1000) - 1))

    folded = rows.groupBy(*names).applyInPandasWithState(fold, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return folded.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.timestamp_micros("us").alias("time"),
                         "value", "n", "forecast", "level")


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over the input that is there now, append its rows to the
    Parquet folder ``path`` and stop. Called again with the same ``checkpoint``
    it goes on after the last finished batch, with its state."""
    query = result.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
