"""File scans and sinks (SRC-1, SRC-2, SNK-1, SNK-2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.expressions import OperatorError, qcol

# The registration-time CSV dialect.
CSV_DIALECT = {"sep": ",", "quote": '"', "escape": '"', "comment": "#", "header": "true",
               "lineSep": None}

_SUPPORTED = (".csv", ".tsv", ".txt", ".parquet")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
             infer_schema: bool = True, schema=None, trim_header: bool = True,
             **options) -> DataFrame:
    """SRC-1/2: CSV scan; extra reader options pass through (quote, escape,
    comment, nullValue, multiLine...). Header names are trimmed.

    ``nrows`` is accepted for parity and applied as a limit.
    """
    if not any(str(path).lower().endswith(s) for s in _SUPPORTED) and not os.path.isdir(path):
        raise OperatorError(f"unsupported file type: {path}")
    nrows = options.pop("nrows", None)
    reader = spark.read.option("sep", sep).option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", str(infer_schema).lower())
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    df = reader.csv(path)
    if trim_header:
        df = df.select(*[qcol(c).alias(c.strip()) for c in df.columns])
    return df.limit(int(nrows)) if nrows else df


def read_csv_dialect(spark: SparkSession, path: str, **overrides) -> DataFrame:
    """SRC-2: the fixed registration dialect (`,` `"` `"` `#`, header row)."""
    opts = {k: v for k, v in CSV_DIALECT.items() if v is not None and k not in ("sep", "header")}
    opts.update(overrides)
    return read_csv(spark, path, sep=CSV_DIALECT["sep"], header=True, **opts)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> str:
    """SNK-1: write a table as CSV (one file per partition, header on each)."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)
    return path


def export_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-2: hand a whole dataset to another process as Parquet (not pickle)."""
    df.write.mode(mode).parquet(path)
    return path


def import_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
