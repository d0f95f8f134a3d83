"""Data-quality counters and row operators on streaming DataFrames.

The reference has no streaming; these keep the stateless operators usable on
``readStream`` sources. Counters are windowed aggregates with a watermark, so
state is bounded and late rows older than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import is_missing, qcol, string_columns
from tabloom.operators.quality import PATTERNS


def quality_counters(stream: DataFrame, time_column: str, window: str = "1 hour",
                     watermark: str = "10 minutes", columns=None) -> DataFrame:
    """DQ-3/5 per event-time window: rows, missing cells per column and
    numeric-looking text per text column."""
    cols = list(columns) if columns else [c for c in stream.columns if c != time_column]
    strs = [c for c in string_columns(stream) if c in cols]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(is_missing(stream, c)).alias(f"missing_{c}") for c in cols]
    aggs += [F.count_if(qcol(c).rlike(PATTERNS["numeric"])).alias(f"numeric_like_{c}") for c in strs]
    return stream.withWatermark(time_column, watermark) \
        .groupBy(F.window(qcol(time_column), window).alias("window")).agg(*aggs)


def clip_stream(stream: DataFrame, column: str, lower=None, upper=None) -> DataFrame:
    """CLN-10 on a stream (stateless projection)."""
    from tabloom.operators.clean import clip
    return clip(stream, column, lower, upper)


def score_stream(stream: DataFrame, scored_with) -> DataFrame:
    """Apply a frozen row-level operator (e.g. a health-score expression built
    from a batch baseline, or a fitted model's ``transform``) to a stream."""
    return scored_with(stream)
